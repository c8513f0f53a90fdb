"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (line hash, number of documents), dealt out and sorted by hash.
Documents come in batches. A batch counts its lines, merge-anti-joins the settled
keys (those already known to be frequent), and adds the rest as a run of level 0.
Whenever a level holds ``fanout`` runs they are merged into one of the next level;
keys that reach the threshold there move to the settled run. All is done with
DataFrame functions.

Edge cases: a null text is one empty line; keys shorter than ``min_chars`` are never
dropped; every row counts as a document of its own, so repeated rows count each; a
null ``doc_id`` is allowed, since rows are never joined by it; further columns pass
through unchanged, but for those named like the two added counts, which give way.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import BLANKS, ascii_lower, stored, two_hashes, whole_text

KEY = ["k1", "k2"]
TEXT_KEY = ["t1", "t2"]
#: Settled keys go to the executors whole only while there are at most so many (16 bytes each).
BROADCAST_KEYS = 1_000_000


def line_keys(text: Column) -> Column:
    """The lines of a text as keys: stripped, A-Z in lower case."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))


def _hashed(keys: Column, min_chars: int) -> Column:
    """Keys as hash pairs; null where the key is too short to be dropped."""
    return F.transform(
        keys,
        lambda key: F.when(F.length(key) >= min_chars, F.struct(*two_hashes(key, *KEY))),
    )


class LineRuns:
    """Levelled runs of line hashes with their document counts."""

    def __init__(self, min_docs: int, fanout: int = 4):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []

    def add(self, counted: DataFrame) -> None:
        """Take the (k1, k2, n) of a batch, each key once."""
        self._place(self._run(self._unsettled(counted)), 0)

    def frequent(self) -> DataFrame:
        """Merge all runs; return the keys found in at least ``min_docs`` documents."""
        rest = [run for level in self.levels for run in level]
        if rest:
            self.levels = []
            self._settle(self._merged(rest))
        return self._known()

    def _known(self) -> DataFrame:
        """The keys of all settled runs, which are disjoint."""
        return functools.reduce(DataFrame.union, self.settled)

    def _unsettled(self, keys: DataFrame) -> DataFrame:
        """Keys not settled yet, by one merge join: each further one would sort in the same tasks, in memory of its own."""
        return keys.join(self._known().hint("merge"), KEY, "left_anti") if self.settled else keys

    def _run(self, counted: DataFrame) -> DataFrame:
        return stored(counted.select(*KEY, "n").sortWithinPartitions(*KEY), "line-run")

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        union = functools.reduce(DataFrame.union, runs)
        return self._run(self._unsettled(union).groupBy(*KEY).agg(F.sum("n").alias("n")))

    def _settle(self, run: DataFrame) -> DataFrame:
        """Move the frequent keys of a run away; return the rest."""
        frequent = run.filter(F.col("n") >= self.min_docs).select(*KEY)
        self.settled.append(stored(frequent.sortWithinPartitions(*KEY), "settled-lines"))
        return run.filter(F.col("n") < self.min_docs)

    def _place(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = self._settle(self._merged(self.levels[level]))
            self.levels[level] = []
            self._place(merged, level + 1)


def frequent_lines(
    docs: DataFrame, min_docs: int, min_chars: int = 1, batches: int = 4, fanout: int = 2,
    batch: Column | None = None, text: str = "text",
) -> DataFrame:
    """Keys (k1, k2) of the lines that at least ``min_docs`` documents hold.

    ``batch`` numbers the batches from 0; by default documents are dealt to
    ``batches`` by the hash of their text. Texts are read once: lines are counted
    per batch, combined before the shuffle, and the batches then pass as narrow tables.
    """
    number = F.pmod(F.hash(whole_text(text)), F.lit(batches)) if batch is None else batch
    counted = (
        docs.select(
            number.cast("int").alias("batch"),
            F.explode(F.array_distinct(_hashed(line_keys(whole_text(text)), min_chars))).alias("key"),
        )
        .filter(F.col("key").isNotNull())
        .groupBy("batch", "key.k1", "key.k2").agg(F.count(F.lit(1)).alias("n"))
    )
    counted = stored(counted, "batch-lines")
    runs = LineRuns(min_docs, fanout)
    for i in range(batches):
        runs.add(counted.filter(F.col("batch") == i))
    return runs.frequent()


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", **batching,
) -> DataFrame:
    """``docs`` with the frequent lines taken out of ``text``, plus ``n_lines`` and ``n_dropped``.

    Where a text loses lines is found once per distinct text: rows (text, place) are
    matched with the frequent keys, by broadcast only while these are few, and the
    places join the texts by their hash. What stays is cut out in slices.
    """
    keys = frequent_lines(docs, min_docs, min_chars, text=text, **batching)
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    keyed = docs.select(
        F.struct("*").alias("doc"), whole_text(text).alias("text"),
        *two_hashes(whole_text(text), *TEXT_KEY),
    )
    places = (
        keyed.select(
            *TEXT_KEY, F.posexplode(_hashed(line_keys(F.col("text")), min_chars)).alias("pos", "key"),
        )
        .filter(F.col("key").isNotNull())
        .select(*TEXT_KEY, "pos", "key.k1", "key.k2")
        .join(keys, KEY, "left_semi")
        .groupBy(*TEXT_KEY).agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    )
    lines = F.split("text", "\n")
    cuts = F.concat(F.array(F.lit(-1)), F.col("drops"), F.array(F.size(lines)))
    between = F.transform(
        F.sequence(F.lit(1), F.size("cuts") - 1),
        lambda j: F.slice(
            "lines", F.get("cuts", j - 1) + 2, F.get("cuts", j) - F.get("cuts", j - 1) - 1,
        ),
    )
    kept = F.when(F.col("drops").isNull(), F.col(f"doc.`{text}`")).otherwise(
        F.array_join(F.flatten(between), "\n"))
    return (
        keyed.join(places, TEXT_KEY, "left")
        .withColumns({"lines": lines, "cuts": cuts})
        .select(
            *[
                kept.alias(name) if name == text else F.col(f"doc.`{name}`")
                for name in docs.columns if name not in ("n_lines", "n_dropped")
            ],
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )
