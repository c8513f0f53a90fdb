"""A trie of conversation prefixes, counted in shards of flat arrays.

1. Turns become 128-bit hashes of role and text before they are shuffled. Conversations are
   ordered and rebuilt on shared openings (``rebuilt_turns``). The digest of a prefix is the
   running exclusive-or of its turns' hashes, each salted with its depth; long conversations
   are scanned in blocks of depths.
2. Distinct prefix digests are the nodes: depth, parent digest, members, words, combined before
   the shuffle. ``below`` counts the member rows in a node's subtree.
3. Nodes with more than ``cut_rows`` rows below are the upper trie. What hangs under it is cut
   off: every cut subtree is bounded, and shards hold whole cut subtrees of some
   ``shard_rows`` nodes. A shard gives each digest a slot by a minimal perfect hash, whose slots
   hold the digests, so an unknown one (the parent of a cut) is told apart; it scatters the
   counts into flat arrays and accumulates them through the array of parent slots, deepest
   level first.
4. The upper trie adds up along conversations: each node and each cut hands its sums to its
   smallest member, a running sum over that member's path collects them from below, and a
   sum over the members of an upper node meets each of them once. So neither a common first
   turn, a long conversation nor a large group of copies is ever one task's group.
5. The ids that end at a node are hashed as a stream: ranges of sorted ids become pieces of
   text, and one task per node reads the pieces in order, as SHA-256 demands.

Edge cases: a null role or text is an empty one; a null turn comes first; turns with equal
numbers are ordered by the hashes of role and text, and repeated rows are turns of their own;
rows with a null ``conv_id`` belong to no conversation and take no part; very long texts are
only hashed and their words counted; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import stored
from rankloom.llm.minmax import mixed
from rankloom.plans.groups import scan_groups

#: Member rows below a node, up to which its subtree is cut off whole; nodes of a shard.
CUT_ROWS, SHARD_ROWS = 4_096, 16_384
#: Depths of a conversation that are scanned together.
BLOCK_DEPTHS = 4_096
#: Upper nodes go to the tasks whole only up to this number (24 bytes each).
BROADCAST_NODES = 200_000
#: Ids in one piece of text.
PIECE_IDS = 256
#: Places for each open digest on a level of the perfect hash, and levels before equal digests are assumed.
ROOM, LEVELS = 1.5, 80

NODE = ["depth", "x", "y"]


class SlotTable:
    """A minimal perfect hash of 128-bit digests: each known one has one of the slots 0..n-1.

    On each level a digest that hashes to a place of its own gets it; the others go on to the
    next level. Slots hold their digests, so that others are recognised.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        x, y = x.view(np.uint64), y.view(np.uint64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        todo, taken = np.arange(len(x)), 0
        while len(todo):
            if len(self.levels) == LEVELS:
                raise ValueError("two nodes have one digest")
            size = max(1, int(ROOM * len(todo)))
            at = self._places(x[todo], y[todo], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, taken - 1 + np.cumsum(alone)))
            taken += int(alone.sum())
            todo = todo[~alone[at]]
        self.x, self.y = x[:0], y[:0]
        slots = self._raw(x, y)
        self.x, self.y = np.empty_like(x), np.empty_like(y)
        self.x[slots], self.y[slots] = x, y

    @staticmethod
    def _places(x: np.ndarray, y: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        return (mixed(mixed(x + salt) ^ y) % np.uint64(size)).astype(np.int64)

    def _raw(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        found, todo = np.full(len(x), -1), np.arange(len(x))
        for level, (alone, slots) in enumerate(self.levels):
            at = self._places(x[todo], y[todo], level, len(alone))
            hit = alone[at]
            found[todo[hit]] = slots[at[hit]]
            todo = todo[~hit]
        return found

    def slots(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for one that is not in the table."""
        x, y = x.view(np.uint64), y.view(np.uint64)
        found = self._raw(x, y)
        known = found >= 0
        known[known] = (self.x[found[known]] == x[known]) & (self.y[found[known]] == y[known])
        return np.where(known, found, -1)


def shard_arrays(depth: np.ndarray, digest: tuple, parent_digest: tuple, own: np.ndarray) -> dict[str, np.ndarray]:
    """Per node (in the order given): children, leaves and the sum of ``own`` in its subtree, and its parent's row or -1."""
    table = SlotTable(*digest)
    slot, n = table.slots(*digest), len(depth)
    parent = np.empty(n, np.int64)
    parent[slot] = table.slots(*parent_digest)
    levels, saved = np.empty(n, np.int64), np.zeros(n, np.int64)
    levels[slot] = depth
    np.add.at(saved, slot, own)
    children = np.bincount(parent[parent >= 0], minlength=n)
    leaves = (children == 0).astype(np.int64)
    order = np.argsort(-levels, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(levels[order])) + 1):
        inner = level[parent[level] >= 0]
        np.add.at(saved, parent[inner], saved[inner])
        np.add.at(leaves, parent[inner], leaves[inner])
    row = np.empty(n, np.int64)
    row[slot] = np.arange(n)
    above = parent[slot]
    return {
        "children": children[slot], "leaves": leaves[slot], "saved": saved[slot],
        "parent": np.where(above >= 0, row[above], -1),
    }


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, words): each turn's place from 1, two hashes of role and text, and its words."""
    role, text = (F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) for name in ("role", "text"))
    slim = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(77), role, text).alias("b"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    return scan_groups(slim, ["conv_id"], order, rank="pos").drop("turn")


def shared_openings(conv_id: Column) -> tuple[Column, Column]:
    """How many turns a conversation takes over, and from which conversation."""
    return F.crc32(conv_id.cast("string")) % 4, conv_id - conv_id % 20


def rebuilt_turns(turns: DataFrame, openings=shared_openings) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, a, b, words) of the rebuilt conversations, and (conv_id, len) of each.

    ``openings`` gives for a conversation the number h of turns that it takes over (at most 3) and
    the donor: it begins with the donor's first h turns and goes on with its own after its first h.
    """
    taken, donor = openings(F.col("conv_id"))
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    plans = own.withColumns({"h": taken.cast("long"), "donor": donor}).join(
        own.select(F.col("conv_id").alias("donor"), F.col("own").alias("offered")), "donor", "left"
    ).withColumn("opening", F.least("h", F.coalesce("offered", F.lit(0))))
    plans = stored(plans.withColumn("len", F.col("opening") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "plans")
    heads = turns.filter(F.col("pos") <= 3).withColumnRenamed("conv_id", "donor").join(
        plans.select("donor", "conv_id", "opening"), "donor").filter(F.col("pos") <= F.col("opening"))
    tails = turns.join(plans.select("conv_id", "h", "opening"), "conv_id").filter(F.col("pos") > F.col("h"))
    what = ["a", "b", "words"]
    rows = heads.select("conv_id", F.col("pos").alias("depth"), *what).unionByName(
        tails.select("conv_id", (F.col("opening") + F.col("pos") - F.col("h")).alias("depth"), *what))
    return rows, plans.select("conv_id", "len")


def prefixes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, px, py, words, len): digests of every prefix and of its parent, the root included."""
    salted = {"hx": F.xxhash64("depth", "a", "b"), "hy": F.xxhash64(F.lit(5), "depth", "a", "b")}
    rows = rows.withColumns({**salted, "block": F.floor((F.col("depth") - 1) / F.lit(BLOCK_DEPTHS))}).drop("a", "b")
    to_here = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.withColumns({"x": F.bit_xor("hx").over(to_here), "y": F.bit_xor("hy").over(to_here)})
    if (lengths.agg(F.max("len")).first()[0] or 0) > BLOCK_DEPTHS:
        earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        long_ones = rows.join(lengths.filter(F.col("len") > BLOCK_DEPTHS), "conv_id", "left_semi")
        offsets = long_ones.groupBy("conv_id", "block").agg(F.bit_xor("hx").alias("hx"), F.bit_xor("hy").alias("hy")).select(
            "conv_id", "block", F.bit_xor("hx").over(earlier).alias("ox"), F.bit_xor("hy").over(earlier).alias("oy"),
        ).filter(F.col("ox").isNotNull())
        scanned = scanned.join(offsets, ["conv_id", "block"], "left").withColumns({
            c: F.col(c).bitwiseXOR(F.coalesce(o, F.lit(0))) for c, o in (("x", "ox"), ("y", "oy"))})
    scanned = scanned.withColumns({"px": F.col("x").bitwiseXOR(F.col("hx")), "py": F.col("y").bitwiseXOR(F.col("hy"))})
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", "len", *[zero.alias(c) for c in ("depth", "x", "y", "px", "py", "words")])
    return scanned.select("conv_id", "depth", "x", "y", "px", "py", "words").join(lengths, "conv_id").unionByName(roots)


def _maybe_broadcast(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_NODES else df


def counted_shards(lower: DataFrame, shards: int) -> DataFrame:
    """The nodes of the cut subtrees (cut_x, cut_y) with children, leaves, saved and their parent's smallest
    member (null under the upper trie)."""
    kept = ["depth", "x", "y", "px", "py", "conv_id", "n_convs", "words"]

    def count(table: pa.Table) -> pa.Table:
        column = {name: table[name].to_numpy() for name in kept}
        found = shard_arrays(
            column["depth"], (column["x"], column["y"]), (column["px"], column["py"]),
            (column["n_convs"] - 1) * column["words"])
        parent = found.pop("parent")
        above = pa.array(column["conv_id"][parent], pa.int64(), mask=parent < 0)
        return pa.table({**{name: table[name] for name in kept},
                         **{name: pa.array(values, pa.int64()) for name, values in found.items()}, "above": above})

    shard = F.pmod(F.xxhash64("cut_x", "cut_y"), F.lit(shards))
    return lower.select(*kept, shard.alias("shard")).groupBy("shard").applyInArrow(
        count, ", ".join(f"{name} long" for name in [*kept, "children", "leaves", "saved", "above"]))


def ends_hashed(paths: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of every node at which conversations end."""
    ends = paths.filter(F.col("depth") == F.col("len")).select("depth", "x", "y", "conv_id")
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[column.to_pylist() for column in batch.columns], strict=True)

    def batch_of(rows: list[tuple], last: str) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["depth", "x", "y", "first", last])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, node, ids = [], None, []
        for *key, conv_id in rows_of(batches):
            if key != node or len(ids) == PIECE_IDS:
                if ids:
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids = key, []
                if len(out) == 4_096:
                    yield batch_of(out, "ids")
                    out = []
            ids.append(conv_id)
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
        yield batch_of(out, "ids")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, node, first, hashed = [], None, 0, None
        for *key, begin, text in rows_of(batches):
            if key == node:
                hashed.update(b"," + text.encode())
                continue
            if node is not None:
                out.append((*node, first, hashed.hexdigest()))
                if len(out) == 4_096:
                    yield batch_of(out, "ends_sha256")
                    out = []
            node, first, hashed = key, begin, hashlib.sha256(text.encode())
        if node is not None:
            out.append((*node, first, hashed.hexdigest()))
        yield batch_of(out, "ends_sha256")

    order = [*NODE, "conv_id"]
    texts = ends.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(
        pieces, "depth long, x long, y long, first long, ids string")
    return texts.repartition(tasks, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        digests, "depth long, x long, y long, first long, ends_sha256 string").drop("first")


def prefix_trie(
    conversations: DataFrame, cut_rows: int = CUT_ROWS, shard_rows: int = SHARD_ROWS, openings=shared_openings,
) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (words saved if shared prefixes are read once, in the subtree), ends_sha256, and the digest (x, y)."""
    turns = stored(ordered_turns(conversations), "turns")
    rows, lengths = rebuilt_turns(turns, openings)
    paths = stored(prefixes(rows, lengths), "prefixes")
    nodes = stored(paths.groupBy(*NODE, "px", "py", "words").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("len") - F.col("depth") + 1).alias("below"),
    ), "nodes")

    is_upper = (F.col("depth") == 0) | (F.col("below") > cut_rows)
    upper = nodes.filter(is_upper)
    counts = nodes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(is_upper, 1).otherwise(0)).alias("upper")).first()
    n_upper, n_lower = counts["upper"] or 0, counts["n"] - (counts["upper"] or 0)
    marked = paths.select("conv_id", *NODE).join(
        _maybe_broadcast(upper.select(*NODE, F.lit(True).alias("upper")), n_upper), NODE, "left")
    marked = stored(marked, "marked-prefixes")
    cuts = marked.filter(F.col("upper").isNull()).groupBy("conv_id").agg(F.min(F.struct(*NODE)).alias("cut"))
    lower = nodes.filter(~is_upper).join(cuts, "conv_id").select(
        "*", F.col("cut.x").alias("cut_x"), F.col("cut.y").alias("cut_y"))
    below = stored(counted_shards(lower, max(1, -(-n_lower // shard_rows))), "counted-nodes")

    # Upper nodes: their children, and the sums of what lies below them.
    children = nodes.filter(F.col("depth") > 0).groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")
    ).agg(F.count(F.lit(1)).alias("children"))
    upper = stored(upper.join(children, NODE, "left").na.fill({"children": 0}), "upper-nodes")
    given = upper.select(
        "conv_id", "depth", F.when(F.col("children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    ).unionByName(below.filter(F.col("above").isNull()).select("conv_id", "depth", "leaves", "saved"))
    zero = F.lit(0).cast("long")
    path = marked.filter("upper").select("conv_id", "depth", "x", "y", zero.alias("leaves"), zero.alias("saved"))
    nothing = F.lit(None).cast("long")
    steps = path.unionByName(given.withColumns({"x": nothing, "y": nothing})).groupBy("conv_id", "depth").agg(
        F.max("x").alias("x"), F.max("y").alias("y"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    collected = scan_groups(
        steps, ["conv_id"], [F.col("depth").desc()], running={"leaves": F.col("leaves"), "saved": F.col("saved")})
    sums = collected.filter(F.col("x").isNotNull()).groupBy(*NODE).agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    parents = _maybe_broadcast(upper.select(
        (F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"),
        F.col("conv_id").alias("upper_conv_id")), n_upper)
    both = upper.join(sums, NODE).withColumn("above", nothing).select(*below.columns).unionByName(below)
    ended = ends_hashed(paths)
    return both.join(parents, ["depth", "px", "py"], "left").join(ended, NODE, "left").select(
        "conv_id", "depth", F.coalesce("above", "upper_conv_id").alias("parent_conv_id"), "n_convs",
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "x", "y",
    )
