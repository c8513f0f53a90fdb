"""Toxicity by weak supervision.

1. Voters. A lexicon of words that go with the toxic label is taken from labelled
   training rows; its words are dealt to several lexicon voters. Further lexicon voters
   hold the words that go with the clean label, and pattern voters look at shouting,
   exclamations, second-person insults and dense lexicon use. A voter says toxic, clean
   or nothing.
2. Label model. Every document votes; equal vote patterns are counted before the shuffle,
   and there are at most 3 to the power of the number of voters of them, whatever the size
   of the table. From the counts a generative model with a hidden label is fitted by
   expectation maximisation: it estimates the share of toxic documents and each voter's
   accuracies. Voters that agree more than the hidden label explains are correlated; the
   excess correlation scales their weight down.
3. Classifier. A logistic regression on word presence and patterns is trained on the
   posterior labels of a sample of training rows, ``sample_rows`` at most, which is a
   documented bound. Its score is what comes out.

Edge cases: a null text is an empty one and gets the score of a text without words; texts
are read whole; repeated rows score alike; a null ``doc_id`` is scored, but never trained
on; without usable labels of both kinds every document gets the share of toxic labels, or
a half without any; an empty table gives no rows; further columns pass through,
but one named ``score`` gives way to the result (not in ``keep_clean``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import stored, trimmed, whole_text

WORD = r"[^\W\d_]+"
#: What pattern voters look for.
SHOUTING, EXCLAIMING = r"\b[^\W\d_a-zß-öø-ÿ]{3,}\b", r"!{2,}"
INSULT = r"(?i)\b(?:you|your|u)\s+(?:are\s+)?(?:an?\s+)?(?:stupid|idiots?|dumb|morons?|losers?|trash|pathetic|ugly|scum)\b"
TOXIC_VOTERS, CLEAN_VOTERS, PATTERN_VOTERS = 5, 2, 3
#: So many of the toxic voters hold words that are nearly always toxic.
SURE_VOTERS = 3
VOTERS = TOXIC_VOTERS + CLEAN_VOTERS + PATTERN_VOTERS


@dataclass(frozen=True)
class Settings:
    #: Labelled rows used for the lexicon and the classifier, at most.
    sample_rows: int = 100_000
    #: Words in the toxic lexicon, in the clean lexicon, and in the classifier's vocabulary, at most.
    toxic_words: int = 100
    clean_words: int = 100
    vocabulary: int = 4096
    #: A lexicon word is in so many sampled rows at least, the toxic share of its rows is so
    #: many times the usual one, and stands out by so many standard deviations; words of the
    #: classifier stand out by fewer.
    least_rows: int = 5
    least_lift: float = 2.0
    lexicon_deviations: float = 5.0
    word_deviations: float = 4.0
    sure_share: float = 0.9
    #: Folds of crc32(doc_id): fold 0 of so many is held out.
    folds: int = 5


@dataclass(frozen=True)
class Voters:
    """Which voter each lexicon word belongs to."""

    toxic: dict[str, int] = field(default_factory=dict)
    clean: dict[str, int] = field(default_factory=dict)

    def votes(self, text: str, words: set[str]) -> list[int]:
        """1 toxic, -1 clean, 0 nothing; by voter."""
        votes = [0] * VOTERS
        hits = [w for w in words if w in self.toxic]
        for word in hits:
            votes[self.toxic[word]] = 1
        for word in words:
            if word in self.clean:
                votes[TOXIC_VOTERS + self.clean[word]] = -1
        at = TOXIC_VOTERS + CLEAN_VOTERS
        shouts = len(re.findall(SHOUTING, text)) > 0.3 * max(len(words), 1)
        votes[at] = 1 if shouts and re.search(EXCLAIMING, text) else 0
        votes[at + 1] = 1 if re.search(INSULT, text) else 0
        votes[at + 2] = 1 if len(hits) >= 2 else 0 if hits else -1
        return votes


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == 0, F.lit(True))


def words_of(text: str) -> set[str]:
    return set(re.findall(WORD, text.lower()))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(text, toxic) of labelled rows outside fold 0; by hash order, ``sample_rows`` at most."""
    known = labels.select("doc_id", "toxic").filter(
        F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), settings.folds),
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_rows)
    return stored(
        docs.select("doc_id", whole_text().alias("text")).join(known, "doc_id").select("text", "toxic"),
        "toxicity-sample")


def word_counts(sample: DataFrame, settings: Settings) -> list:
    """(word, toxic rows, clean rows) of the words that tell most; bounded by the vocabulary.

    Words of the sample are counted where they are; the strongest are kept by their
    deviation from the share of toxic rows.
    """
    @trimmed
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                words = sorted(words_of(text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.string()), pa.array([toxic] * len(words), pa.int32())], ["word", "toxic"])

    n = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    if not n["toxic"] or n["toxic"] == n["n"]:
        return []
    share = n["toxic"] / n["n"]
    counted = sample.mapInArrow(explode, "word string, toxic int").groupBy("word").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("toxic").alias("toxic"),
    ).filter(F.col("rows") >= settings.least_rows)
    expected = F.col("rows") * share
    strength = F.abs(F.col("toxic") - expected) / F.sqrt(expected * (1 - share))
    return counted.withColumn("strength", strength).filter(
        F.col("strength") >= settings.word_deviations).orderBy(
        F.desc("strength"), "word").limit(settings.vocabulary).collect()


def lexicons(counts: list, share: float, settings: Settings) -> Voters:
    """The strongest words of each class, dealt to voters in turn; nearly sure ones apart."""
    counts = [r for r in counts if r["strength"] >= settings.lexicon_deviations]
    toxic = [r for r in counts if r["toxic"] >= min(0.9, settings.least_lift * share) * r["rows"]]
    clean = [r for r in counts if r["toxic"] < share * r["rows"]]
    toxic = toxic[:settings.toxic_words]
    sure = [r["word"] for r in toxic if r["toxic"] >= settings.sure_share * r["rows"]]
    others = [r["word"] for r in toxic if r["toxic"] < settings.sure_share * r["rows"]]
    return Voters(
        {w: i % SURE_VOTERS for i, w in enumerate(sure)}
        | {w: SURE_VOTERS + i % (TOXIC_VOTERS - SURE_VOTERS) for i, w in enumerate(others)},
        {r["word"]: i % CLEAN_VOTERS for i, r in enumerate(clean[:settings.clean_words])})


def vote_patterns(docs: DataFrame, voters: Voters) -> DataFrame:
    """(pattern, n): how many documents vote alike. Counted in the tasks, summed over them."""
    @trimmed
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for text in batch[0].to_pylist():
                pattern = "".join("-0+"[v + 1] for v in voters.votes(text, words_of(text)))
                counts[pattern] = counts.get(pattern, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    return docs.select(whole_text().alias("text")).mapInArrow(
        vote, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def unpacked(patterns: list[str]) -> np.ndarray:
    """Votes as indices: 0 clean, 1 nothing, 2 toxic."""
    return np.array([["-0+".index(c) for c in p] for p in patterns], np.int64).reshape(-1, VOTERS)


class LabelModel:
    """A hidden label, voters that depend on it, and the correlations it leaves over."""

    def __init__(self, patterns: list[str], counts: np.ndarray, share: float, rounds: int = 100):
        votes, weight = unpacked(patterns), counts / counts.sum()
        seen = np.eye(3)[votes]  # pattern, voter, vote
        self.share = share
        # A voter starts out better than chance in the direction it votes.
        self.given = np.empty((2, VOTERS, 3))
        base = np.einsum("p,pjv->jv", weight, seen)
        lean = np.array([[2.0, 1.0, 0.4], [0.4, 1.0, 2.0]])
        self.given = base * lean[:, None, :] + 1e-6
        self.given /= self.given.sum(axis=2, keepdims=True)
        self.scale = np.ones(VOTERS)
        for step in range(rounds):
            posterior = self._posterior(votes)
            if step in (5, 20, 50):
                self.scale = self._scales(seen, weight, posterior)
            toxic = weight * posterior
            self.share = float(np.clip(toxic.sum(), 1e-4, 1 - 1e-4))
            for label, mass in ((1, toxic), (0, weight - toxic)):
                self.given[label] = np.einsum("p,pjv->jv", mass, seen) + 1e-6
                self.given[label] /= self.given[label].sum(axis=1, keepdims=True)

    def _scales(self, seen: np.ndarray, weight: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """1 / sqrt(1 + excess correlation with the others), by voter."""
        value = seen @ np.array([-1.0, 0.0, 1.0])
        inside = np.zeros((VOTERS, VOTERS))
        for mass in (weight * posterior, weight * (1 - posterior)):
            mean = (mass @ value) / max(mass.sum(), 1e-12)
            centred = value - mean
            inside += (centred * mass[:, None]).T @ centred
        deviation = np.sqrt(np.maximum(np.diag(inside), 1e-12))
        self.correlations = inside / np.outer(deviation, deviation)
        excess = np.maximum(self.correlations - np.eye(VOTERS), 0).clip(0, 1)
        np.fill_diagonal(excess, 0)
        return 1 / np.sqrt(1 + excess.sum(axis=1))

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.given)
        odds = np.log(self.share / (1 - self.share)) + sum(
            self.scale[j] * (logs[1, j, votes[:, j]] - logs[0, j, votes[:, j]]) for j in range(VOTERS))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def posterior(self, patterns: list[str]) -> dict[str, float]:
        return dict(zip(patterns, self._posterior(unpacked(patterns)).tolist(), strict=True)) if patterns else {}


@dataclass(frozen=True)
class Classifier:
    bias: float
    words: dict[str, float]
    patterns: tuple[float, ...] = (0.0,) * PATTERN_VOTERS

    def score(self, text: str) -> float:
        get = self.words.get
        odds = self.bias + sum(get(w, 0.0) for w in words_of(text))
        odds += sum(w * x for w, x in zip(self.patterns, pattern_features(text), strict=True))
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def pattern_features(text: str) -> tuple[float, ...]:
    return (
        float(bool(re.search(SHOUTING, text))), float(bool(re.search(EXCLAIMING, text))),
        float(bool(re.search(INSULT, text))))


def train(sample: DataFrame, voters: Voters, posterior: dict[str, float], vocabulary: list[str]) -> Classifier:
    """Logistic regression on the posterior labels, by Spark ML: each row counts for both labels."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector, VectorUDT
    from pyspark.sql import types as T

    place = {word: i for i, word in enumerate(vocabulary)}
    width = len(vocabulary) + PATTERN_VOTERS

    @F.udf(T.ArrayType(T.DoubleType()))
    def believed(text):
        pattern = "".join("-0+"[v + 1] for v in voters.votes(text, words_of(text)))
        return [posterior[pattern]]

    @F.udf(VectorUDT())
    def features(text):
        found = sorted(place[w] for w in words_of(text) if w in place)
        values = [1.0] * len(found)
        for i, x in enumerate(pattern_features(text)):
            if x:
                found.append(len(place) + i)
                values.append(x)
        return SparseVector(width, found, values)

    rows = stored(sample.select(features("text").alias("features"), believed("text")[0].alias("p")), "toxicity-rows")
    both = rows.select("features", "p", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("label")).select(
        "features", "label", F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p")).alias("weight"))
    model = LogisticRegression(weightCol="weight", regParam=max(1e-4, 1 / rows.count()), maxIter=60, standardization=False).fit(both)
    weights = model.coefficients.toArray()
    return Classifier(
        float(model.intercept),
        {w: float(weights[i]) for w, i in place.items() if weights[i]},
        tuple(float(x) for x in weights[len(place):]))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Classifier:
    """Voters from labelled rows, their accuracies from all rows, the classifier from both."""
    sample = training_rows(docs, labels, settings)
    counts = word_counts(sample, settings)
    seen = sample.agg(F.avg("toxic")).first()[0]
    if not counts:
        share = 0.5 if seen is None else min(max(seen, 1e-3), 1 - 1e-3)
        return Classifier(float(np.log(share / (1 - share))), {})
    voters = lexicons(counts, seen, settings)
    patterns = vote_patterns(docs, voters).collect()  # bounded by the number of voters
    names = [row["pattern"] for row in patterns]
    model = LabelModel(names, np.array([row["n"] for row in patterns], float), seen)
    return train(sample, voters, model.posterior(names), [r["word"] for r in counts])


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with ``score``."""
    @F.pandas_udf("double")
    def score(texts):
        return texts.map(model.score).astype(float)

    return docs.select(
        *[F.col(f"`{name}`") for name in docs.columns if name != "score"], score(whole_text()).alias("score"))


def keep_clean(docs: DataFrame, model: Classifier, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below ``threshold``, with their own columns."""
    rows = docs.select(F.struct("*").alias("doc"), whole_text().alias("text"))
    return scored(rows, model).filter(F.col("score") < threshold).select("doc.*")
