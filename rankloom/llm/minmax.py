"""Near duplicates by min-max hashing of word shingles, confirmed on whole sets.

1. Each text becomes the set of the hashes of its five-word shingles. Texts with equal
   sets are one class, so copies cost no further work, however many there are.
2. Each permutation gives two values, the least and the greatest; bands of these values
   are hashed into buckets. Bands are as wide as the threshold allows (``layout``): a pair
   at the threshold shares no band with a probability of at most ``MISSED``, 5 in a million,
   more alike pairs far less often. At 85 % these are 26 bands of 6 values, at 80 % 32 of 5.
3. Buckets with the same members are worked on once. A bucket is a task's group; a large one
   (more than ``tile`` classes, or ``TILE_SHINGLES`` in all) is cut into tiles, whose members
   first meet one of them, the pivot. Those linked with it are one component already, so
   afterwards only the others meet all members, tile by tile: a bucket of near copies of one text
   costs its size, and no pair that could join two components is left out. A group
   counts the shared shingles of its members on the whole sets and returns, for those it
   finds linked, a forest: fewer links than members.
4. The links' components are found by stars.

Edge cases: words are separated by ASCII white space, and A-Z are lower-cased; a text with
fewer words than a shingle is one shingle; without words or with a null text the set is
empty and linked with nothing; rows of one ``doc_id`` are documents of their own, so
each goes by its own text; a null ``doc_id`` gets the class of its text but represents
none, and a class of such rows alone has a null component and keeps them; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import stored, trimmed, whole_text
from rankloom.llm.components import components

WORDS = 5
#: Permutations (each gives two values); low thresholds take more.
PERMUTATIONS = 80
#: Bound of the probability that a pair at the threshold shares no band.
MISSED = 5e-6
#: Shingles permuted at once, and bytes of text split at once.
SLAB, PIECE = 1 << 14, 1 << 22
#: Classes in buckets (key, least id, number) go to the tasks whole only up to this number (32 bytes each).
BROADCAST_IDS = 1_000_000
#: Shingles of a tile, on average: 8 bytes each.
TILE_SHINGLES = 2_000_000
HASH = np.dtype("<u8")
#: The tile of a large bucket's pivot.
PIVOT = -1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def layout(threshold: float) -> tuple[int, int, int]:
    """(permutations, bands, values per band) for a threshold in percent: the widest bands within ``MISSED``."""
    if not 0 < threshold <= 100:
        raise ValueError(f"a threshold in percent, above 0 and up to 100: {threshold}")
    alike = threshold / 100
    for width in range(PERMUTATIONS, 0, -1):
        bands = 2 * PERMUTATIONS // width
        if (1 - alike ** width) ** bands <= MISSED:
            return PERMUTATIONS, bands, width
    bands = math.ceil(math.log(MISSED) / math.log1p(-alike))
    return -(-bands // 2), bands, 1


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` odd factors and summands."""
    numbers = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return numbers[:n] | np.uint64(1), numbers[n:]


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words, in order; long texts are split piece by piece at white space."""
    data, at, parts = text.encode().lower(), 0, []
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = data[at:end].split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted set of shingle hashes."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes.astype(HASH)
    width = min(words, len(hashes))
    places = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    n = len(hashes) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += mixed(hashes[k:k + n]) * places[k]
    return np.unique(mixed(total)).astype(HASH)


def band_hashes(shingle_set: np.ndarray, count: int, bands: int, width: int) -> list[int]:
    """One hash per band of the min-max signature, for a ``layout``."""
    factors, summands = permutations(count)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    greatest = np.zeros(count, np.uint64)
    for at in range(0, len(shingle_set), SLAB):
        values = shingle_set[None, at:at + SLAB] * factors[:, None] + summands[:, None]
        least = np.minimum(least, values.min(axis=1))
        greatest = np.maximum(greatest, values.max(axis=1))
    signature = np.concatenate([least, greatest])[:bands * width].reshape(bands, width).astype(HASH)
    hashes = [xxhash.xxh3_64_intdigest(band.tobytes(), seed=i) for i, band in enumerate(signature)]
    return np.array(hashes, np.uint64).view(np.int64).tolist()


def signatures(docs: DataFrame, words: int = WORDS, threshold: float = 85) -> DataFrame:
    """(doc_id, key, n_shingles, bands); the key of a set is null if it is empty."""
    shape = layout(threshold)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64()))])

    @trimmed
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, bands = [], [], []
            for text in batch[1].to_pylist():
                found = shingles(text, words)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                bands.append(band_hashes(found, *shape) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(bands, schema.field("bands").type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(
        sign, "doc_id long, key binary, n_shingles long, bands array<long>")


def linked(sets: list[np.ndarray], first: int, threshold: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of linked sets with i among the ``first`` ones: 100 |A and B| >= threshold |A or B|."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, place, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = owner[np.argsort(place, kind="stable")]
    begin = np.cumsum(df) - df
    ends = np.cumsum(sizes)
    pairs = []
    for i in range(first):
        mine = place[ends[i] - sizes[i]:ends[i]]
        mine = mine[df[mine] > 1]
        if not len(mine):
            continue
        runs = df[mine]
        at = np.repeat(begin[mine] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        shared = np.bincount(holders[at], minlength=len(sets))
        found = np.flatnonzero(100 * shared >= threshold * (sizes[i] + sizes - shared))
        pairs += [(i, int(j)) for j in found if j != i]
    return pairs


def forest(ids: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A link from every id to the least one of its tree."""
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            low, high = (a, b) if ids[a] < ids[b] else (b, a)
            parent[high] = low
    return [(ids[x], ids[root(x)]) for x in range(len(ids)) if root(x) != x]


def confirmed(groups: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v) of the groups (bucket, one, two, tile, id, shingles), each sorted together in a task.

    A link is returned once, however many groups find it, and links of many tasks come together, so that
    they are not written to a file a task: Hadoop's local file system starts two processes for each file.
    """
    names = ["bucket", "one", "two"]

    @trimmed
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            found = []
            columns = [batch[i].to_pylist() for i in range(6)]
            for bucket, one, two, tile, doc, data in zip(*columns, strict=True):
                if (bucket, one, two) != key:
                    found += links_of(key, members)
                    key, members = (bucket, one, two), []
                members.append((tile != one, doc, np.frombuffer(data, HASH)))
            yield batch_of(found)
        yield batch_of(links_of(key, members))

    def links_of(key: tuple, members: list[tuple]) -> list[tuple[int, int]]:
        if len(members) < 2:
            return []
        members.sort(key=lambda m: m[:2])
        first = sum(not m[0] for m in members) if key[1] != key[2] else len(members)
        ids = [m[1] for m in members]
        return forest(ids, linked([m[2] for m in members], first, threshold))

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        groups.select(*names, "tile", "id", "shingles").repartition(4 * tasks, *names)
        .sortWithinPartitions(*names).mapInArrow(confirm, "u long, v long").distinct()
    )


def near_duplicates(docs: DataFrame, threshold: int = 85, words: int = WORDS, tile: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Linked are texts of which ``threshold`` percent of all shingles are shared.
    """
    signed = stored(signatures(docs, words, threshold), "min-max")
    classes = stored(
        signed.filter(F.col("key").isNotNull()).groupBy("key").agg(
            F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"),
        ).filter(F.col("least").isNotNull()).withColumn("id", F.monotonically_increasing_id()), "text-classes")
    placed = classes.select("id", "size", F.explode("bands").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"),
        F.bit_xor(F.xxhash64("id", F.lit(3))).alias("y"), F.sum("size").alias("all"), F.min("id").alias("pivot"),
    ).filter(F.col("n") > 1)
    buckets = buckets.groupBy("n", "x", "y").agg(*[F.min(c).alias(c) for c in ("bucket", "all", "pivot")])
    buckets = buckets.select("bucket", "pivot", _tiles("n", "all", tile).alias("tiles"))
    members = stored(placed.join(buckets, "bucket"), "bucket-members")

    active = classes.select("key", "least", "id").join(members.select("id").distinct(), "id", "left_semi")
    if active.count() <= BROADCAST_IDS:
        active = F.broadcast(active)
    shingle_sets = _sets(docs, active, words)
    small, large = members.filter("tiles = 1"), members.filter("tiles > 1")
    groups = small.select("bucket", F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("tile"), "id").unionByName(
        pivot_groups(large))
    links = stored(confirmed(groups.join(shingle_sets, "id"), threshold), "near-links")
    if not large.isEmpty():
        apart = stored(groups_apart(large, links, tile), "members-apart")
        links = links.unionByName(stored(confirmed(apart.join(shingle_sets, "id"), threshold), "near-links"))

    reached = components(links).join(classes.select("id", "least"), "id")
    least = reached.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(reached.select("id", "component").join(least, "component"), "id", "left").select(
        F.col("key").alias("class"), F.coalesce("component_id", "least").alias("component_id"))
    return signed.join(named, F.col("key") == F.col("class"), "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _tiles(count: str, shingles: str, tile: int) -> Column:
    """Tiles for so many classes with so many shingles."""
    return F.ceil(F.greatest(F.col(count) / tile, F.col(shingles) / TILE_SHINGLES)).cast("int")


def _tile(tiles: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(4)), tiles).cast("int")


def pivot_groups(large: DataFrame) -> DataFrame:
    """(bucket, one, two, tile, id): every tile of a large bucket (id, tiles, pivot) with the pivot in front."""
    others = large.filter(F.col("id") != F.col("pivot")).withColumn("tile", _tile(F.col("tiles")))
    pivots = large.filter(F.col("id") == F.col("pivot")).select(
        "bucket", "id", F.lit(PIVOT).alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("two"))
    one = F.lit(PIVOT).alias("one")
    return others.select("bucket", one, F.col("tile").alias("two"), "tile", "id").unionByName(
        pivots.select("bucket", one, "two", "tile", "id"))


def groups_apart(large: DataFrame, links: DataFrame, tile: int) -> DataFrame:
    """(bucket, one, two, tile, id) of large buckets: members that are not linked with the pivot meet all others.

    Their tiles come first; every two tiles meet of which one is among them.
    """
    near = links.select(F.col("u").alias("id"), F.col("v").alias("pivot"), F.lit(True).alias("near")).distinct()
    known = large.join(near, ["id", "pivot"], "left").withColumn(
        "near", F.coalesce("near", F.col("id") == F.col("pivot")))
    count, size = F.lit(1), F.col("size")
    sizes = known.groupBy("bucket").agg(*[
        F.sum(F.when(kind, value).otherwise(0)).alias(name) for name, kind, value in (
            ("near_n", F.col("near"), count), ("near_all", F.col("near"), size),
            ("apart_n", ~F.col("near"), count), ("apart_all", ~F.col("near"), size))])
    sizes = sizes.filter(F.col("apart_n") > 0).select(
        "bucket", _tiles("apart_n", "apart_all", tile).alias("firsts"), _tiles("near_n", "near_all", tile).alias("rest"))
    tiled = known.select("bucket", "id", "near").join(sizes, "bucket").withColumn(
        "tile", F.when(F.col("near"), F.col("firsts") + _tile(F.col("rest"))).otherwise(_tile(F.col("firsts"))))
    pairs = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("firsts") + F.col("rest") - 1))).filter(
        F.least("tile", "other") < F.col("firsts"))
    return pairs.select("bucket", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "tile", "id")


def _sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(id, shingles): the whole set of each class (key, least, id), from a document with its least ``doc_id``."""
    @trimmed
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, words).tobytes() for text in batch["text"].to_pylist()]
            own = [xxhash.xxh3_128_digest(data) == key
                   for data, key in zip(sets, batch["key"].to_pylist(), strict=True)]
            whole = pa.RecordBatch.from_arrays([batch["id"], pa.array(sets, pa.binary())], ["id", "shingles"])
            yield whole.filter(pa.array(own, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("least"), whole_text().alias("text"))
    found = texts.join(classes, "least").select("id", "key", "text").mapInArrow(build, "id long, shingles binary")
    return found.groupBy("id").agg(F.first("shingles").alias("shingles"))
