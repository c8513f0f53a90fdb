"""Shards of near-equal load by vector bin packing.

Documents are grouped by equal texts. A group has a load vector: bytes, tokens, rows.
Groups are summed into ``blocks`` by their hash; one with more than 1/1024 of all rows or
bytes has a block of its own. Only a group of more than a quarter of a shard's fair share
of rows or bytes is split, over blocks by the hash of ``doc_id``. The blocks,
whose number is bounded whatever the size of the table, are then placed one by one, the
largest first: each goes to the shard where the dot product of its load with the
residual capacity is highest. Only the block table passes through the driver.

Within a shard, slots run on from block to block. The rows of a large group are numbered in
pieces by the hash of ``doc_id``, those of other blocks at once, so no task sees more than a piece.

Edge cases: a null text has size 1, no checksum and no tokens, and forms one group;
repeated rows of one ``doc_id`` get slots of their own; a null ``doc_id`` comes first in
its piece; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import stored, two_hashes

LOADS = ("bytes", "tokens", "rows")
#: A group of equal texts is split above this part of a shard's fair share of rows or bytes.
SPLIT_PART = 1 / 4
LARGE = "g1 long, g2 long, parts long, own long"
PLACED = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("shard", T.IntegerType()),
    T.StructField("before", T.LongType()),
])


def word_count(text: Column) -> Column:
    """Tokens for the balance: words between white space."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def place_blocks(loads: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each block (rows of ``loads``): highest dot product with what is left.

    Loads are measured in shares of a shard's capacity, so the kinds weigh alike.
    """
    shares = loads / np.maximum(loads.sum(axis=0) / shards, 1)
    left = np.ones((shards, loads.shape[1]))
    shard = np.empty(len(loads), np.int32)
    for i in np.argsort(-shares.max(axis=1), kind="stable"):
        shard[i] = np.argmax(left @ shares[i])
        left[shard[i]] -= shares[i]
    return shard


def shard_documents(
    docs: DataFrame, shards: int = 16, blocks: int = 32768, tokens=word_count,
) -> DataFrame:
    """doc_id, size, n_tokens, text_crc32, block, shard, slot of every document."""
    spark = docs.sparkSession
    text = F.col("text")
    rows = stored(docs.select(
        "doc_id", *two_hashes(text, "g1", "g2"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(tokens(text), F.lit(0)).alias("n_tokens"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    ), "shard-rows")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    if not total["n"]:
        return rows.select(
            "doc_id", "size", "n_tokens", "text_crc32", F.lit(0).cast("long").alias("block"),
            F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # Groups above one part in 1,024 of all rows or bytes: fewer than 2,048 of them.
    fair_rows, fair_size = total["n"] / 1024, total["size"] / 1024
    limit_rows, limit_size = (total[x] / shards * SPLIT_PART for x in ("n", "size"))
    n, s = F.col("n"), F.col("s")
    large = rows.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).filter(
        (n > 1) & ((n > fair_rows) | (s > fair_size))).select(
        "g1", "g2", F.ceil(F.greatest(n / max(1.0, fair_rows / 8), s / max(1.0, fair_size / 8))).alias("parts"),
        ((n > limit_rows) | (s > limit_size)).alias("split")).orderBy("g1", "g2").collect()
    own = [(g["g1"], g["g2"], g["parts"], None if g["split"] else blocks + i) for i, g in enumerate(large)]
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("parts")), F.lit(0))
    blocked = rows.join(F.broadcast(spark.createDataFrame(own, LARGE)), ["g1", "g2"], "left").withColumn(
        "piece", piece,
    ).withColumn("block", F.coalesce("own", F.pmod(F.xxhash64("g1", "g2", "piece"), F.lit(blocks)))).withColumn(
        "piece", F.when(F.col("own").isNull(), 0).otherwise(F.col("piece")))
    pieces = blocked.groupBy("block", "piece").agg(
        F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"),
    ).orderBy("block", "piece").toPandas()  # one row per block, and up to 8,192 pieces for each kind of load
    sums = pieces.groupby("block", as_index=False)[list(LOADS)].sum()
    loads = sums[list(LOADS)].to_numpy(np.float64)
    shard = place_blocks(loads, shards)
    of_piece = shard[np.searchsorted(sums["block"].to_numpy(), pieces["block"].to_numpy())]
    before = np.zeros(len(pieces), np.int64)
    for i in range(shards):
        here = np.flatnonzero(of_piece == i)
        before[here] = np.cumsum(pieces["rows"].to_numpy()[here]) - pieces["rows"].to_numpy()[here]
    placed = spark.createDataFrame(list(zip(
        pieces["block"].tolist(), pieces["piece"].tolist(), of_piece.tolist(), before.tolist(), strict=True)), PLACED)
    in_piece = Window.partitionBy("block", "piece").orderBy("doc_id", "g1", "g2")
    return (
        blocked.join(F.broadcast(placed), ["block", "piece"])
        .withColumn("slot", F.col("before") + F.row_number().over(in_piece) - 1)
        .select("doc_id", "size", "n_tokens", "text_crc32", "block", "shard", "slot")
    )
