"""Shaping of ranking datasets: groups, splits, lists and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.keys import seeded_hash, seeded_int
from rankloom.plans.groups import scan_groups
from rankloom.schema import require_columns, require_list

# Rows per bucket of consecutive row numbers; bounds the work of one task.
INDEX_BUCKET = 100_000
# Items of one list; a longer list goes on in a further part.
LIST_ITEMS = 100_000
SAMPLE_STEPS = 1_000_000
# Relative error of the quantiles that bracket a cut.
BRACKET = 1e-3


# -- groups --------------------------------------------------------------------

def assign_groups(
    rows: DataFrame, sizes: DataFrame, index: str = "row_index", bucket: int = INDEX_BUCKET
) -> DataFrame:
    """Give consecutive rows the number of their group.

    ``rows`` has a dense 0-based ``index``; ``sizes`` has (group_index, size).
    Running sums of the sizes give the first row of each group. Groups leave
    one marker row in each bucket of row numbers that they touch, and within a
    bucket each row takes the last marker before it, so a group that spans
    most of the table is spread over its buckets.
    """
    ends = scan_groups(
        sizes.where(F.col("size") > 0), [], [F.col("group_index")],
        running={"_end": F.col("size").cast("long")},
    )
    start, last = F.col("_end") - F.col("size"), F.col("_end") - 1
    width = F.lit(bucket)
    markers = ends.select(
        F.col("group_index").alias("query_id"),
        start.alias("_start"),
        F.explode(F.sequence(F.floor(start / width), F.floor(last / width))).alias("_bucket"),
    )
    markers = markers.select(
        "_bucket",
        F.greatest(F.col("_start"), F.col("_bucket") * width).alias("_at"),
        F.lit(0).alias("_is_row"),
        "query_id",
    )
    numbered = rows.select(
        F.floor(F.col(index) / width).alias("_bucket"),
        F.col(index).cast("long").alias("_at"),
        F.lit(1).alias("_is_row"),
        F.lit(None).cast("long").alias("query_id"),
        F.struct(*rows.columns).alias("_row"),
    )
    w = Window.partitionBy("_bucket").orderBy("_at", "_is_row")
    merged = numbered.unionByName(markers, allowMissingColumns=True).withColumn(
        "query_id", F.last("query_id", ignorenulls=True).over(w)
    )
    return merged.where(F.col("_is_row") == 1).select("_row.*", "query_id")


def group_sizes(df: DataFrame) -> DataFrame:
    """Rows of each query."""
    return df.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))


# -- splits --------------------------------------------------------------------

def tail_split(df: DataFrame, frac: float = 0.1, order_col: str = "doc_id") -> DataFrame:
    """The last rows by a unique numeric column, from row int(n * (1 - frac)) on.

    Only the value at the cut is looked for. Approximate quantiles bracket it,
    the rows below the bracket are counted, and the few rows inside are
    ranked; the table itself is filtered and never shuffled.
    """
    n = df.count()
    first = int(n * (1.0 - frac))
    if first <= 0 or first >= n:
        return df if first <= 0 else df.limit(0)
    share, near = first / n, BRACKET
    low, high = df.approxQuantile(
        order_col, [max(0.0, share - 2 * near), min(1.0, share + 2 * near)], near
    )
    value = F.col(order_col)
    below = df.where(value < F.lit(low)).count()
    inside = df.where((value >= F.lit(low)) & (value <= F.lit(high))).select(order_col)
    ranked = scan_groups(inside, [], [value], rank="_rank")
    cut = ranked.where(F.col("_rank") == first - below + 1).first()[order_col]
    return df.where(value >= F.lit(cut))


def take_first(df: DataFrame, n: int, order_col: str) -> DataFrame:
    return df.orderBy(order_col).limit(n)


def train_test_split(
    df: DataFrame, test_size: int, seed: int, key: str
) -> tuple[DataFrame, DataFrame]:
    """Seeded split with exactly ``test_size`` test rows.

    The test rows are the first by seeded hash of ``key``, which must be
    unique. Only the hash of the last test row is fetched; both parts are then
    filters without a shuffle.
    """
    place = F.struct(seeded_hash(seed, F.col(key)), F.col(key))
    cut = (
        df.select(place.alias("p")).orderBy("p").limit(test_size)
        .agg(F.max("p").alias("p")).select("p.*").first()
    )
    if cut is None or cut[0] is None:
        return df, df.limit(0)
    is_test = place <= F.struct(F.lit(cut[0]), F.lit(cut[1]).cast(df.schema[key].dataType))
    return df.where(~is_test), df.where(is_test)


def sample_queries(df: DataFrame, share: float, seed: int, round_: int = 0) -> DataFrame:
    """Whole queries, each drawn with probability ``share`` anew for every round."""
    place = F.pmod(seeded_int(seed, F.lit(round_), F.col("query_id")), F.lit(SAMPLE_STEPS))
    return df.where(place < int(share * SAMPLE_STEPS))


def assign_batches(df: DataFrame, size: int, seed: int, key: str, exact: bool = False) -> DataFrame:
    """Add ``batch_id`` in seeded order, for batches of ``size`` rows.

    By default rows are hashed to ``ceil(n / size)`` batches, without a
    shuffle; ``exact`` cuts the seeded order every ``size`` rows.
    """
    if exact:
        order = [seeded_hash(seed, F.col(key)), F.col(key)]
        numbered = scan_groups(df, [], order, rank="_row")
        return numbered.withColumn("batch_id", F.floor((F.col("_row") - 1) / size)).drop("_row")
    batches = max(1, -(-df.count() // size))
    return df.withColumn("batch_id", F.pmod(seeded_int(seed, F.col(key)), F.lit(batches)))


def batches_without_duplicates(df: DataFrame, size: int, seed: int, key: str, text: str) -> DataFrame:
    """Add ``batch_id`` so that no batch of at most ``size`` rows holds a text twice.

    Rows are numbered with equal texts side by side and dealt in turn to as many batches as are needed:
    ``max(ceil(n / size), copies of the commonest text)``, of which no assignment can do with
    fewer. Batches differ by one row at most. A NULL text is one like any other.
    """
    copies = df.groupBy(F.xxhash64(text), F.xxhash64(F.lit(seed), text)).agg(F.count(F.lit(1)).alias("n"))
    row = copies.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    batches = max(1, -(-(row["n"] or 0) // size), row["most"] or 0)
    order = [F.md5(F.col(text)), seeded_hash(seed, F.col(key)), F.col(key)]
    dealt = scan_groups(df, [], order, rank="_row")
    return dealt.withColumn("batch_id", F.pmod(F.col("_row") - 1, F.lit(batches))).drop("_row")


# -- lists ---------------------------------------------------------------------

def explode_lists(df: DataFrame, docs: str = "docs", labels: str = "labels") -> DataFrame:
    """One row per list item: (query_id, pos, doc, label), pos from 0.

    Lists in parts go on counting: ``start`` is the position of a part's first item.
    """
    zipped = F.arrays_zip(F.col(docs).alias("doc"), F.col(labels).alias("label"))
    start = F.col("start") if "start" in df.columns else F.lit(0)
    exploded = df.select("query_id", start.alias("_start"), F.posexplode(zipped).alias("pos", "_item"))
    return exploded.select(
        "query_id", (F.col("_start") + F.col("pos")).cast("long").alias("pos"), "_item.doc", "_item.label")


def collect_lists(df: DataFrame, doc: str = "doc", items: int = LIST_ITEMS) -> DataFrame:
    """Ragged lists (query_id, part, start, docs, labels) in the order of ``pos``.

    A list of more than ``items`` places goes on in the next ``part``, which
    keeps every row of the result within bounds. ``pos`` counts from 0.
    """
    part = F.floor(F.col("pos") / F.lit(items))
    grouped = df.groupBy("query_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col(doc).alias("doc"), "label"))).alias("_list")
    )
    return grouped.select(
        "query_id", "part", (F.col("part") * F.lit(items)).alias("start"),
        F.transform("_list", lambda x: x["doc"]).alias("docs"),
        F.transform("_list", lambda x: x["label"]).alias("labels"),
    )


def validate_lists(df: DataFrame, docs: str = "docs", labels: str = "labels") -> DataFrame:
    """The lists whose documents and labels differ in number."""
    require_list(require_list(require_columns(df, "query_id"), docs), labels)
    n_docs = F.coalesce(F.size(docs), F.lit(0))
    n_labels = F.coalesce(F.size(labels), F.lit(0))
    return df.where(n_docs != n_labels).select(
        "query_id", *[c for c in ("part",) if c in df.columns], n_docs.alias("n_docs"), n_labels.alias("n_labels")
    )


def to_rerank_samples(
    df: DataFrame, query: str, positive: str, documents: list[str] | str | None = None
) -> DataFrame:
    """N-tuples to (query, positive ARRAY, documents ARRAY).

    The documents are the columns after the first two unless named, or those of one array column.
    """
    if isinstance(documents, str):
        listed = F.coalesce(F.col(documents), F.array().cast(df.schema[documents].dataType))
    else:
        listed = F.array(*(documents or df.columns[2:]))
    present = F.filter(listed, lambda d: d.isNotNull())
    return df.select(
        F.col(query).alias("query"), F.array(positive).alias("positive"), present.alias("documents")
    )


def label_by_membership(df: DataFrame, positive: str = "positive", documents: str = "documents") -> DataFrame:
    """One row per document of a sample, labeled 1 if it is among the positives."""
    kept = [c for c in df.columns if c not in (positive, documents)]
    rows = df.select(*kept, positive, F.posexplode(documents).alias("pos", "document"))
    label = F.array_contains(F.col(positive), F.col("document")).cast("int")
    return rows.select(*kept, "pos", "document", label.alias("label"))


def dataset_profile(df: DataFrame, features: str = "features") -> DataFrame:
    """Number of rows and of features."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size(features)).alias("n_features")
    )
