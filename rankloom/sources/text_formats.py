"""Text formats of ranking data: svmlight, LETOR, group sizes, raw test lines.

Each format has a parser over a DataFrame with a ``value`` column, which also
works on a stream, and a reader over files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.vectors import densify

# Places of the fields in a raw test line, from the front or (negative) from the end.
RAW_LINE_FIELDS = {
    "label": 0,
    "cosine_score": 2,
    "search_order": 3,
    "ctr": 4,
    "query": -4,
    "title": -3,
}
RAW_LINE_DROPPED = r"['#]"

_PAIR = r"^\d+:"


def _features(items: Column) -> Column:
    pairs = F.filter(items, lambda item: item.rlike(_PAIR))
    return F.map_from_entries(
        F.transform(
            pairs,
            lambda item: F.struct(
                F.substring_index(item, ":", 1).cast("int"),
                F.substring_index(item, ":", -1).cast("double"),
            ),
        )
    )


def _shift_to_one(parsed: DataFrame, zero_based: bool | str) -> DataFrame:
    """Features numbered from 1; with "auto" an index 0 anywhere means a file from 0."""
    if zero_based == "auto":
        lowest = parsed.agg(F.min(F.array_min(F.map_keys("features")))).first()[0]
        zero_based = lowest == 0
    if not zero_based:
        return parsed
    return parsed.withColumn("features", F.transform_keys("features", lambda i, _: i + 1))


def _width(parsed: DataFrame) -> int:
    return parsed.agg(F.max(F.array_max(F.map_keys("features")))).first()[0] or 0


def parse_svmlight(lines: DataFrame, zero_based: bool | str = "auto") -> DataFrame:
    """``label idx:val ...`` to (label, features MAP from 1-based index)."""
    items = F.split(F.trim(F.regexp_replace("value", r"#.*$", "")), r"\s+")
    parsed = lines.withColumn("_items", items).where(F.element_at("_items", 1) != "")
    parsed = parsed.select(
        *[c for c in lines.columns if c != "value"],
        F.element_at("_items", 1).cast("double").alias("label"),
        _features(F.col("_items")).alias("features"),
    )
    return _shift_to_one(parsed, zero_based)


def read_svmlight(
    spark: SparkSession,
    path: str,
    n_features: int | None = None,
    zero_based: bool | str = "auto",
) -> DataFrame:
    """Read svmlight files to (label, features ARRAY).

    Without ``n_features`` the width is the largest index of these files, so
    pass the width of the training files on to the others.
    """
    parsed = parse_svmlight(spark.read.text(path), zero_based)
    width = n_features or _width(parsed)
    return parsed.select("label", densify(F.col("features"), width).alias("features"))


def parse_letor(lines: DataFrame) -> DataFrame:
    """``label qid:Q i:v ... # comment`` to (label, qid, features MAP, comment)."""
    value = F.col("value")
    body = F.trim(F.regexp_replace(value, r"#.*$", ""))
    comment = F.regexp_extract(value, r"#\s*(.*?)\s*$", 1)
    items = F.split(body, r"\s+")
    parsed = lines.withColumns({"_items": items, "comment": comment})
    return parsed.where(F.element_at("_items", 1) != "").select(
        *[c for c in lines.columns if c != "value"],
        F.element_at("_items", 1).cast("double").alias("label"),
        F.regexp_extract(value, r"\bqid:(\S+)", 1).alias("qid"),
        _features(F.col("_items")).alias("features"),
        "comment",
    )


def read_letor(spark: SparkSession, path: str) -> DataFrame:
    return parse_letor(spark.read.text(path))


def parse_ltr_lines(lines: DataFrame) -> DataFrame:
    """Raw test lines to named columns, by position of the space-separated fields."""
    fields = F.split(F.regexp_replace(F.rtrim("value"), RAW_LINE_DROPPED, ""), " ")
    picked = [
        F.try_element_at(F.col("_fields"), F.lit(place if place < 0 else place + 1)).alias(name)
        for name, place in RAW_LINE_FIELDS.items()
    ]
    kept = [c for c in lines.columns if c != "value"]
    return lines.withColumn("_fields", fields).select(*kept, *picked)


def read_ltr_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_ltr_lines(spark.read.text(path))


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, value) of all lines that are not blank, from 0 in file order.

    Lines stay where they are read. Each file split is counted, the counts are
    summed in file order, and a line adds its place within its split to the
    lines of earlier splits. There is one offset per split, so the offsets are
    small enough to send around.
    """
    split = ["_file", "_start"]
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
    )
    counts = lines.groupBy(*split).agg(
        F.count(F.lit(1)).alias("_lines"), F.min("_line").alias("_first")
    )
    earlier = Window.partitionBy(F.lit(0)).orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *split, "_first", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before")
    )
    placed = lines.join(F.broadcast(offsets), split)
    return placed.select((F.col("_before") + F.col("_line") - F.col("_first")).alias("row_index"), "value")


def read_group_sizes(spark: SparkSession, path: str) -> DataFrame:
    """One group size per line to (group_index, size)."""
    return number_lines(spark, path).select(
        F.col("row_index").alias("group_index"), F.trim("value").cast("long").alias("size")
    )
