"""Repair of conversation structure over a suffix-shared automaton.

1. The rows of a conversation are ordered and get a fault each: blank, duplicate or truncated.
   Its signature has one letter a row: role and fault. Rows are numbered by a scan that
   splits large groups; repeats are found by the first place of each role and text.
2. Equal signatures are repaired once, and equal ends of different signatures too: sorted from
   their ends, signatures come one after the other with their longest common ends, so
   the automaton of all suffixes is built and minimised with one path of nodes in memory.
   A node is a letter and the node behind it. Once per node and state of the grammar
   ``(s?(ua)+)?`` it gets the least cost of the rest and the best audit letter; the rest of the
   best audit is the letter of the next node and state, so suffixes are linked and
   never copied. Every letter leads to one state, so among equal costs the least
   letter begins the least audit.
3. Audits go back to the rows in pieces of ``PIECE_ROWS`` rows, and the repaired rows of a
   conversation are hashed as a stream, in order. A signature and an audit have a byte a row, as the
   result itself; texts are never gathered.

Edge cases: a null role, text or number counts as one space where rows are damaged and written
(so a null text is blank); a null turn comes first; rows with equal turns are ordered by the
hashes of role and text, and repeated rows follow each other; rows with a null ``conv_id`` are one
conversation, whose result has a null ``conv_id``; roles count by their first letter, and one that is
none of s, u, a (or empty) is illegal anywhere; very long texts are streamed; ties are broken as stated; a
conversation without rows has an empty audit and costs nothing; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import BLANKS, stored
from rankloom.plans.groups import scan_groups

#: Rows whose part of an audit travels together.
PIECE_ROWS = 256
#: Repaired signatures go to the tasks whole only up to so many characters.
BROADCAST_CHARS = 4_000_000
#: What an edit costs, and what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

# States of the grammar: at the start, after s, after u, after a. It may end at the start or after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEPT = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
#: Where a user or assistant leads that is put in or takes a row's place: only one of them fits.
FORCED = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLES = ("user", "user", "assistant", "user")
#: The letter of a row that must go.
GONE = "-"
#: Cost of the end, by state.
END = (0, 2 * INSERT, INSERT, 0)

Node = tuple[int, tuple[int, ...], str]  # least cost of all states, costs beyond it, best letters


def suffix_node(letter: str, behind: Node, memo: dict) -> Node:
    """The node of a letter in front of a node: costs and best letters for each state of the grammar."""
    base, beyond, _ = behind
    known = memo.get((letter, beyond))
    if known is None:
        known = memo[letter, beyond] = _relaxed(letter, beyond)
    added, costs, best = known
    return base + added, costs, best


def _relaxed(letter: str, beyond: tuple[int, ...]) -> Node:
    options = []
    extra = TRUNCATED if letter.isupper() else 0
    for state in range(4):
        ways = {"D": DELETE + beyond[state]}
        if letter != GONE:
            ways["R"] = REROLE + extra + beyond[FORCED[state]]
            after = KEPT.get(letter.lower(), {}).get(state)
            if after is not None:
                ways["K"] = extra + beyond[after]
        options.append(ways)
    costs = [min(ways.values()) for ways in options]
    for _ in range(4):  # rows put in front, one after the other
        costs = [min(cost, INSERT + costs[FORCED[state]]) for state, cost in enumerate(costs)]
    best = ""
    for state, ways in enumerate(options):
        ways["I"] = INSERT + costs[FORCED[state]]
        best += min(way for way, cost in ways.items() if cost == costs[state])
    least = min(costs)
    return least, tuple(c - least for c in costs), best


def end_node() -> Node:
    """Behind the last row: rows are put in until the grammar may end."""
    return 0, END, "".join("I" if cost else "." for cost in END)


def next_state(letter: str, edit: str, state: int) -> int:
    return state if edit == "D" else KEPT[letter.lower()][state] if edit == "K" else FORCED[state]


def audit_pieces(signature: str, path: list[Node]) -> tuple[list[int], list[str]]:
    """The best audit in pieces of ``PIECE_ROWS`` rows with the state before each; ``path`` ends at the first row."""
    states, pieces, letters, state = [], [], [], START
    for row, letter in enumerate(signature):
        if row % PIECE_ROWS == 0:
            if row:
                pieces.append("".join(letters))
            states.append(state)
            letters = []
        node = path[len(signature) - row]
        while (edit := node[2][state]) == "I":
            letters.append(edit)
            state = FORCED[state]
        letters.append(edit)
        state = next_state(letter, edit, state)
    while path[0][2][state] == "I":
        letters.append("I")
        state = FORCED[state]
    return states, [*pieces, "".join(letters)]


class SuffixPath:
    """The automaton's path for the current signature; sorted signatures share it from the end."""

    def __init__(self):
        self.path, self.reversed, self.memo, self.nodes = [end_node()], "", {}, 0

    def follow(self, signature: str) -> list[Node]:
        backwards = signature[::-1]
        common = 0
        for x, y in zip(backwards, self.reversed):
            if x != y:
                break
            common += 1
        del self.path[common + 1:]
        for letter in backwards[common:]:
            self.path.append(suffix_node(letter, self.path[-1], self.memo))
            self.nodes += 1
        self.reversed = backwards
        return self.path


def repaired_signatures(signatures: DataFrame) -> DataFrame:
    """(signature, cost, states, pieces) of distinct signatures: the least cost and the audit in pieces."""
    tasks = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "signature string, cost long, states array<int>, pieces array<string>"

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixPath()
        for batch in batches:
            found = []
            for signature in batch["signature"].to_pylist():
                path = automaton.follow(signature)
                base, beyond, _ = path[-1]
                found.append((base + beyond[START], *audit_pieces(signature, path)))
            costs, states, pieces = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([
                batch["signature"], pa.array(costs, pa.int64()), pa.array(states, pa.list_(pa.int32())),
                pa.array(pieces, pa.list_(pa.string()))], ["signature", "cost", "states", "pieces"])

    ends = signatures.withColumn("ends", F.reverse("signature"))
    return ends.repartitionByRange(tasks, "ends").sortWithinPartitions("ends").select("signature").mapInArrow(repair, schema)


def named(conv_id: Column) -> Column:
    """A key without nulls."""
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copy): rows after the damage that CRC-32 of ``conv_id:turn`` modulo 20 decides."""
    role, text = (F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" ")) for name in ("role", "text"))
    rows = conversations.select(
        named(F.col("conv_id").cast("long")).alias("conv"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    kind = F.crc32(F.concat_ws(":", "conv", named(F.col("turn")))) % 20
    rows = rows.withColumn("kind", kind).filter(F.col("kind") != 0)
    changed = F.when(F.col("kind") == 1, "").when(
        F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) with their place ``pos`` from 1 and two hashes of role and text."""
    hashed = rows.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(77), "role", "text")})
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    return scan_groups(hashed, ["conv"], order, rank="pos")


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, pos, fault, letter, initial) of numbered rows; the first fault counts: blank, duplicate, truncated."""
    text = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    slim = rows.select(
        "conv", "turn", "pos", "a", "b", initial.alias("initial"), (text == "").alias("blank"),
        (~F.substring(text, -1, 1).isin(".", "!", "?")).alias("cut"))
    firsts = slim.groupBy("conv", "a", "b").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    faulty = slim.join(firsts, ["conv", "pos"], "left").withColumn("fault", fault)
    letter = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(
        F.col("fault").isNotNull(), F.upper("initial")).otherwise(F.col("initial"))
    return faulty.select("conv", "turn", "pos", "fault", letter.alias("letter"), "initial")


def joined(rows: DataFrame, keys: list[str], order: str, *letters: str) -> DataFrame:
    """The strings ``letters`` of each group, one after the other by ``order``."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *letters))).alias("listed"))
    return listed.select(*keys, *[F.array_join(F.col(f"listed.{name}"), "").alias(name) for name in letters])


def piece_of(pos: Column) -> Column:
    return F.floor((pos - 1) / F.lit(PIECE_ROWS)).cast("int")


def repaired_hashes(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): ``role:text`` lines after the edits, hashed as they pass."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nothing = F.lit(None).cast("string")
    both = rows.select(
        "conv", piece_of(F.col("pos")).alias("piece"), "pos", "role", "text", nothing.alias("edits"), F.lit(0).alias("state"),
    ).unionByName(pieces.select(
        "conv", "piece", F.lit(0).cast("long").alias("pos"), nothing.alias("role"), nothing.alias("text"), "edits", "state"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, lines, edits, at, state, out = None, None, "", 0, START, []

        def add(role: str, text: str) -> None:
            nonlocal lines
            line = f"{role}:{text}".encode()
            if lines is None:
                lines = hashlib.sha256(line)
            else:
                lines.update(b"\n" + line)

        def put_in() -> None:
            nonlocal at, state
            while at < len(edits) and edits[at] == "I":
                add(ROLES[state], "")
                at, state = at + 1, FORCED[state]

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["conv", "repaired_sha256"])

        def finish() -> None:
            put_in()
            if conv is not None:
                out.append((conv, (lines or hashlib.sha256()).hexdigest()))

        for batch in batches:
            for key, role, text, own, before in zip(*[
                    batch[name].to_pylist() for name in ("conv", "role", "text", "edits", "state")], strict=True):
                if own is not None:
                    if key != conv:
                        finish()
                        conv, lines = key, None
                    else:
                        put_in()
                    edits, at, state = own, 0, before
                    continue
                put_in()
                edit, at = edits[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role = ROLES[state]
                state = next_state(role[:1], edit, state)
                add(role, text)
            yield batch_of()
        finish()
        yield batch_of()

    return both.repartition(tasks, "conv").sortWithinPartitions("conv", "piece", "pos").mapInArrow(
        stream, "conv string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ordered rows (``numbered``): conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256, and its signature."""
    faults = stored(with_faults(rows), "faults")
    own = faults.groupBy("conv").agg(
        *[F.sum(F.when(F.col("fault") == kind, 1).otherwise(0)).cast("long").alias(kind)
          for kind in ("blank", "duplicate", "truncated")],
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    by_piece = joined(
        faults.withColumn("piece", piece_of(F.col("pos"))), ["conv", "piece"], "pos", "letter", "initial")
    signed = stored(joined(by_piece, ["conv"], "piece", "letter", "initial").withColumnRenamed("letter", "signature"), "signatures")

    fixed = stored(repaired_signatures(signed.select("signature").distinct()), "repaired-signatures")
    chars = fixed.agg(F.sum(F.length("signature") + F.length(F.array_join("pieces", "")))).first()[0] or 0
    found = signed.join(F.broadcast(fixed) if chars <= BROADCAST_CHARS else fixed, "signature")
    pieces = found.select("conv", F.posexplode(F.arrays_zip("states", "pieces")).alias("piece", "part")).select(
        "conv", "piece", F.col("part.pieces").alias("edits"), F.col("part.states").alias("state"))
    legal = F.regexp_count("initial", F.lit("(?=su|ua|au)"))
    results = found.select(
        "conv", (F.length("initial") - 1 - legal).cast("long").alias("illegal"), "cost",
        F.array_join("pieces", "").alias("audit"), "signature")
    return own.join(results, "conv").join(repaired_hashes(rows, pieces), "conv")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """One row per original ``conv_id``: what the damage did to it, and its cheapest repair."""
    rows = stored(numbered(damaged(conversations)), "damaged")
    every = conversations.select(named(F.col("conv_id").cast("long")).alias("conv")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(repair(rows), "conv", "left").select(
        F.when(F.col("conv") != " ", F.col("conv")).cast("long").alias("conv_id"),
        *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
