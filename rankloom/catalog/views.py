"""Views on the given tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.catalog.registry import Tables
from rankloom.functions.rank_math import bucketize
from rankloom.functions.vectors import mean_vectors
from rankloom.operators.retrieval import retrieve

# Graded label of each event type; others are 0.
EVENT_LABELS = {"purchase": 3.0, "click": 2.0, "view": 1.0}

# A query is a user, its documents are the user's events.
JUDGMENTS = """judgments as (
  select user_id as query_id, event_id as doc_id, event_id as pos,
         cast(case event_type when 'purchase' then 3 when 'click' then 2 when 'view' then 1 else 0 end
              as double) as label,
         value as score, value / cast(100 as double) as logit
  from events)"""


def judgments(t: Tables) -> DataFrame:
    label = F.lit(0.0)
    for kind, value in EVENT_LABELS.items():
        label = F.when(F.col("event_type") == kind, F.lit(value)).otherwise(label)
    return t.events.select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"),
        F.col("event_id").alias("pos"), label.alias("label"),
        F.col("value").alias("score"), (F.col("value") / F.lit(100.0)).alias("logit"),
    )


# Positions by score and by label, on top of the judgments.
RANKED = JUDGMENTS + """,
ranked as (
  select *, row_number() over (partition by query_id order by score desc, doc_id) as rk,
         row_number() over (partition by query_id order by label desc, doc_id) as ik
  from judgments)"""

# Each document with one benchmark item as its query.
TEXT_PAIRS = """text_pairs as (
  select b.item_id as query_id, d.doc_id, b.text as query, d.text as document
  from documents d join benchmark b on d.doc_id % (select count(*) from benchmark) = b.item_id)"""


def text_pairs(t: Tables) -> DataFrame:
    items = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    documents = t.documents.select(
        F.pmod("doc_id", F.lit(t.benchmark.count())).alias("query_id"),
        "doc_id", F.col("text").alias("document"),
    )
    return documents.join(items, "query_id")


# Whole-document labels with a class and a logit from the length.
PREDICTIONS = """predictions as (
  select l.doc_id, cast(l.quality as double) as label, l.quality + l.toxic as cls,
         (d.n_chars % 1000) / cast(250 as double) - cast(2 as double) as logit
  from labels l join documents d using (doc_id)),
classed as (
  select *, case when logit <= 0 then 0 when logit < 0.4 then 1 else 2 end as predicted
  from predictions)"""


def predictions(t: Tables) -> DataFrame:
    lengths = t.documents.select("doc_id", "n_chars")
    return t.labels.join(lengths, "doc_id").select(
        "doc_id",
        F.col("quality").cast("double").alias("label"),
        (F.col("quality") + F.col("toxic")).alias("cls"),
        (F.pmod("n_chars", F.lit(1000)) / F.lit(250.0) - F.lit(2.0)).alias("logit"),
    ).withColumn("predicted", bucketize(F.col("logit")))


# User turns with the answers that follow them.
TURNS = """turns as (
  select u.conv_id * 100 + u.turn as anchor_id, u.text as anchor, a.text as positive
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant')"""


def turns(t: Tables) -> DataFrame:
    asked = t.conversations.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("anchor")
    )
    answers = t.conversations.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("positive")
    )
    anchor_id = F.col("conv_id") * 100 + F.col("turn") - 1
    return asked.join(answers, ["conv_id", "turn"]).select(
        anchor_id.alias("anchor_id"), "anchor", "positive"
    )


# One query for each label of the vectors: their mean vector, with a benchmark text.
VECTORS = """vector_parts as (
  select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings),
vector_means as (
  select label, i, avg(cast(x as double)) as x from vector_parts group by label, i),
vector_queries as (
  select cast(label as bigint) as query_id, list(x order by i) as embedding
  from vector_means group by label),
vector_corpus as (
  select vec_id as doc_id, cast(embedding as double[]) as embedding, label from embeddings),
scored_docs as (
  select q.query_id, c.doc_id, c.label,
         round(list_cosine_similarity(q.embedding, c.embedding), 12) as bi_score
  from vector_queries q cross join vector_corpus c),
stage1 as (
  select *, row_number() over (partition by query_id order by bi_score desc, doc_id) as stage1_rank
  from scored_docs)"""


def vector_queries(t: Tables) -> DataFrame:
    means = mean_vectors(t.embeddings, ["label"])
    texts = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return means.select(F.col("label").cast("long").alias("query_id"), "embedding").join(
        texts, "query_id", "left"
    )


def vector_corpus(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def stage1(t: Tables, k: int) -> DataFrame:
    return retrieve(vector_queries(t), vector_corpus(t), k)


# Every pair of a label's query with one of its own documents.
POSITIVES = """positives as (
  select cast(label as bigint) as query_id, vec_id as doc_id from embeddings)"""


def positives(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.col("label").cast("long").alias("query_id"), F.col("vec_id").alias("doc_id")
    )


SPACES = (
    r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def tok(text: str) -> str:
    """SQL for the tokens of a text."""
    return f"list_filter(string_split_regex(lower({text}), '{SPACES}'), lambda t: t <> '')"


def overlap(left: str, right: str) -> str:
    return f"len(list_distinct(list_intersect({tok(left)}, {tok(right)})))"


def lexical(query: str, document: str) -> str:
    """SQL for the lexical score."""
    product = f"cast(len({tok(query)}) as double) * len({tok(document)})"
    return f"coalesce({overlap(query, document)} / sqrt(greatest({product}, 1.0)), 0.0)"


def seeded(seed: int, *keys: str) -> str:
    """SQL for the seeded hash."""
    return f"md5(concat_ws(':', '{seed}', {', '.join(f'cast({k} as varchar)' for k in keys)}))"


def seeded_number(seed: int, *keys: str) -> str:
    return f"cast('0x' || substr({seeded(seed, *keys)}, 1, 15) as bigint)"


def one_if(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))
