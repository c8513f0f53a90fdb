"""Formats, groups, splits, lists, corpora and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.catalog.mining import FIVE, SEED, mined_five
from rankloom.catalog.registry import Tables, fresh_path, query, r
from rankloom.catalog.views import JUDGMENTS, TURNS, judgments, seeded, seeded_number, tok, turns
from rankloom.functions.text import token_count
from rankloom.functions.vectors import densify
from rankloom.operators.mining import shape_negatives
from rankloom.operators.ranking import rank_within_query
from rankloom.plans.groups import null_safe_join, scan_groups
from rankloom.sources import corpus as corpora
from rankloom.sources import datasets, datasource, sinks, text_formats
from rankloom.streaming.corpus_stream import read_documents, stream_corpus


# -- text formats ------------------------------------------------------------------

def index_values(first: int) -> Column:
    """``idx:val`` items of the vectors, numbered from ``first``."""
    return F.array_join(
        F.transform(
            "embedding",
            lambda x, i: F.concat_ws(":", (i + first).cast("string"), x.cast("double").cast("string")),
        ),
        " ",
    )


def exploded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("features").alias("place", "value"))


VALUES = """parts as (
  select vec_id, label, cast(unnest(embedding) as double) as x,
         cast(generate_subscripts(embedding, 1) - 1 as integer) as place from embeddings)"""


def width(t: Tables) -> int:
    """The number of features, from the data."""
    return t.embeddings.agg(F.max(F.size("embedding"))).first()[0]


@query(f"with {VALUES} select vec_id, cast(label as double) as label, place, {r('x')} as value from parts")
def svmlight_lines(t: Tables):
    line = F.concat_ws(" ", F.col("label").cast("string"), index_values(0))
    lines = t.embeddings.select("vec_id", line.alias("value"))
    parsed = text_formats.parse_svmlight(lines)
    dense = parsed.select("vec_id", "label", densify(F.col("features"), width(t)).alias("features"))
    return exploded(dense, "vec_id", "label")


@query(f"with {VALUES} select vec_id, place, {r('greatest(x, 0.0)')} as value from parts")
def densified_features(t: Tables):
    """Only the positive values are stored; the others come back as 0."""
    pairs = F.transform("embedding", lambda x, i: F.struct(i + 1, x.cast("double").alias("x")))
    stored = F.map_from_entries(F.filter(pairs, lambda p: p["x"] > 0))
    dense = t.embeddings.select("vec_id", densify(stored, width(t)).alias("features"))
    return exploded(dense, "vec_id")


LETOR_ROWS = f"""with {VALUES} select vec_id, cast(label as double) as label, 'q' || (vec_id % 7) as qid,
  'vector ' || vec_id as comment, place, {r('x')} as value from parts"""


@query(LETOR_ROWS)
def letor_lines(t: Tables):
    qid = F.concat(F.lit("qid:q"), F.pmod("vec_id", F.lit(7)).cast("string"))
    comment = F.concat(F.lit("# vector "), F.col("vec_id").cast("string"))
    line = F.concat_ws(" ", F.col("label").cast("string"), qid, index_values(1), comment)
    parsed = text_formats.parse_letor(t.embeddings.select("vec_id", line.alias("value")))
    return of_letor(parsed, "vec_id")


def of_letor(rows: DataFrame, *keys: str) -> DataFrame:
    """One row a feature, numbered from 0."""
    return rows.select(*keys, "label", "qid", "comment", F.explode("features").alias("index", "value")).select(
        *keys, "label", "qid", "comment", (F.col("index") - 1).alias("place"), "value")


@query(LETOR_ROWS)
def letor_source_round_trip(t: Tables):
    """Vectors written and read by the LETOR data source, all values compared."""
    datasource.register(t.spark)
    path = fresh_path(t, "letor")
    rows = t.embeddings.select(
        F.col("label").cast("double"), F.concat(F.lit("q"), F.pmod("vec_id", F.lit(7)).cast("string")).alias("qid"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("comment"))
    rows.write.format("letor").option("keepZeros", "true").mode("overwrite").save(path)
    back = t.spark.read.format("letor").option("partitionBytes", 1 << 20).load(path)
    return of_letor(back).withColumn("vec_id", F.substring_index("comment", " ", -1).cast("long"))


@query(f"with {VALUES} select cast(label as double) as label, place, {r('sum(x)')} as total, count(*) as n from parts group by all")
def svmlight_source_round_trip(t: Tables):
    """Vectors written from index 0 and read as arrays by the svmlight data source."""
    datasource.register(t.spark)
    path = fresh_path(t, "svmlight")
    rows = t.embeddings.select(F.col("label").cast("double"), F.col("embedding").cast("array<double>").alias("features"))
    rows.write.format("svmlight").option("zeroBased", "true").mode("overwrite").save(path)
    back = t.spark.read.format("svmlight").options(numFeatures=width(t), zeroBased="true").load(path)
    return exploded(back, "label").groupBy("label", "place").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"""select event_id, case event_type when 'click' then '1' else '0' end as label, {r('value')} as cosine_score,
  cast(user_id as varchar) as search_order, cast(event_id % 100 as varchar) as ctr,
  event_type as query, 'title' || event_id as title from events""")
def raw_test_lines(t: Tables):
    """Lines of sixteen fields with stray quotes and hashes."""
    clicked = F.when(F.col("event_type") == "click", F.lit("1")).otherwise(F.lit("0"))
    fields = [
        clicked, F.lit("x"), F.col("value").cast("string"), F.col("user_id").cast("string"),
        F.pmod("event_id", F.lit(100)).cast("string"), *[F.lit(f"f{i}") for i in range(5, 12)],
        F.concat(F.lit("'"), F.col("event_type"), F.lit("'")),
        F.concat(F.lit("#title"), F.col("event_id").cast("string")), F.lit("u"), F.lit("v\n"),
    ]
    lines = t.events.select("event_id", F.concat_ws(" ", *fields).alias("value"))
    parsed = text_formats.parse_ltr_lines(lines)
    return parsed.withColumn("cosine_score", F.col("cosine_score").cast("double"))


# -- groups and splits -------------------------------------------------------------

@query("""select event_id, row_number() over (order by user_id, event_id) - 1 as row_index, user_id as query_id
from events""")
def rows_assigned_to_groups(t: Tables):
    order = [F.col("user_id"), F.col("event_id")]
    rows = scan_groups(t.events.select("event_id", "user_id"), [], order, rank="_rank")
    rows = rows.select("event_id", (F.col("_rank") - 1).cast("long").alias("row_index"))
    sizes = datasets.group_sizes(judgments(t)).withColumnRenamed("query_id", "group_index")
    return datasets.assign_groups(rows, sizes)


@query(f"with {JUDGMENTS} select query_id, count(*) as size from judgments group by query_id")
def group_sizes(t: Tables):
    return datasets.group_sizes(judgments(t))


@query("""select event_id from (
  select event_id, row_number() over (order by event_id) as rn, count(*) over () as n from events)
where rn > cast(floor(n * 0.9) as bigint)""")
def last_tenth_of_rows(t: Tables):
    return datasets.tail_split(t.events.select("event_id"), 0.1, "event_id")


@query("select event_id, event_type from events order by event_id limit 1000")
def first_1000_rows(t: Tables):
    return datasets.take_first(t.events.select("event_id", "event_type"), 1000, "event_id")


@query(f"""select event_id, case when row_number() over (order by {seeded(SEED, 'event_id')}, event_id) <= 200
  then 'test' else 'train' end as part from events""")
def seeded_train_test_split(t: Tables):
    train, test = datasets.train_test_split(t.events.select("event_id"), 200, SEED, "event_id")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(f"""select distinct user_id as query_id from events
where {seeded_number(SEED, '3', 'user_id')} % 1000000 < 500000""")
def queries_of_one_boosting_round(t: Tables):
    sampled = datasets.sample_queries(judgments(t), 0.5, SEED, round_=3)
    return sampled.select("query_id").distinct()


@query("select count(*) as n_rows, cast(max(len(embedding)) as integer) as n_features from embeddings")
def dataset_profile(t: Tables):
    return datasets.dataset_profile(t.embeddings.select(F.col("embedding").alias("features")))


# -- lists -------------------------------------------------------------------------

def placed(t: Tables) -> DataFrame:
    """Judgments with dense positions from 0 in the order of the events."""
    ranked = scan_groups(judgments(t), ["query_id"], [F.col("doc_id")], rank="_rank")
    return ranked.withColumn("pos", F.col("_rank") - 1).withColumn("doc", F.col("doc_id").cast("string"))


@query(f"""with {JUDGMENTS} select query_id, cast(0 as bigint) as part, string_agg(doc_id, ',' order by doc_id) as docs,
  string_agg(cast(label as integer), ',' order by doc_id) as labels from judgments group by query_id""")
def collected_lists(t: Tables):
    lists = datasets.collect_lists(placed(t))
    return lists.select(
        "query_id", "part", F.array_join("docs", ",").alias("docs"),
        F.array_join(F.col("labels").cast("array<int>").cast("array<string>"), ",").alias("labels"),
    )


@query(f"""with {JUDGMENTS} select query_id,
  row_number() over (partition by query_id order by doc_id) - 1 as pos,
  cast(doc_id as varchar) as doc, label from judgments""")
def exploded_lists(t: Tables):
    return datasets.explode_lists(datasets.collect_lists(placed(t)))


@query(f"""with {JUDGMENTS} select query_id, cast(0 as bigint) as part, cast(count(*) as integer) as n_docs,
  cast(count(*) filter (where score >= 1) as integer) as n_labels
from judgments group by query_id having count(*) <> count(*) filter (where score >= 1)""")
def lists_with_missing_labels(t: Tables):
    """Lists in which scores below 1 have lost their label."""
    scored = F.when(F.col("score") >= 1, F.col("label"))
    ragged = placed(t).withColumn("label", scored)
    lists = datasets.collect_lists(ragged)
    return datasets.validate_lists(
        lists.withColumn("labels", F.filter("labels", lambda x: x.isNotNull()))
    )


WIDE = """wide as (
  select conv_id, max(text) filter (where turn = 0) as question, max(text) filter (where turn = 1) as answer,
         coalesce(list(text order by turn) filter (where role = 'assistant' and text is not null), []) as answers
  from conversations group by conv_id)"""


def with_answers(t: Tables) -> DataFrame:
    """A row per conversation with its assistant turns as an ordered list; very long lists go on in further rows."""
    said = t.conversations.where("role = 'assistant' and text is not null").select(
        F.col("conv_id").alias("query_id"), "turn", "text", F.lit(None).cast("int").alias("label"))
    placed = scan_groups(said, ["query_id"], [F.col("turn"), F.col("text")], rank="pos")
    lists = datasets.collect_lists(placed.withColumn("pos", F.col("pos") - 1), "text")

    def at(turn: int) -> Column:
        return F.max(F.when(F.col("turn") == turn, F.col("text")))

    rows = t.conversations.groupBy("conv_id").agg(at(0).alias("question"), at(1).alias("answer"))
    return null_safe_join(rows, lists.select(F.col("query_id").alias("conv_id"), "docs"), ["conv_id"], "left")


@query(f"""with {WIDE} select md5(question) as query, md5(answer) as positive,
  cast(len(answers) as integer) as n_documents
from wide""")
def reranking_samples(t: Tables):
    samples = datasets.to_rerank_samples(with_answers(t), "question", "answer", "docs")
    return samples.select(
        F.md5("query").alias("query"), F.md5(F.element_at("positive", 1)).alias("positive"),
        F.size("documents").alias("n_documents"),
    )


@query(f"""with {WIDE},
docs as (select question, answer, unnest(answers) as document from wide)
select md5(question) as query, md5(document) as document,
  case when answer is null then null else cast(document = answer as integer) end as label from docs""")
def labels_by_membership(t: Tables):
    samples = datasets.to_rerank_samples(with_answers(t), "question", "answer", "docs")
    labeled = datasets.label_by_membership(samples)
    return labeled.select(F.md5("query").alias("query"), F.md5("document").alias("document"), "label")


# -- corpora -----------------------------------------------------------------------

def length_encoder(df: DataFrame) -> DataFrame:
    """A stand-in for a model: two numbers that SQL can repeat."""
    numbers = F.array(token_count(F.col("text")).cast("double"), F.length("text").cast("double"))
    return df.withColumn("embedding", numbers)


ENCODED = f"""select doc_id, cast(len({tok('text')}) as double) as tokens, cast(length(text) as double) as chars
from documents"""


def encoded(corpus: DataFrame) -> DataFrame:
    return corpus.select(
        "doc_id", F.element_at("embedding", 1).alias("tokens"), F.element_at("embedding", 2).alias("chars")
    )


@query(ENCODED)
def appended_corpus(t: Tables):
    documents = t.documents.select("doc_id", "text", "lang")
    old = documents.where(F.col("lang") == "en").drop("lang")
    new = documents.where(F.col("lang") != "en").drop("lang")
    built = corpora.build_corpus(old, length_encoder)
    return encoded(corpora.append_corpus(built, new, length_encoder))


@query(ENCODED)
def streamed_corpus(t: Tables):
    schema = t.documents.select("doc_id", "text").schema
    stream = read_documents(t.spark, f"{t.sf_dir}/documents.parquet*", schema)
    path = fresh_path(t, "corpus")
    run = stream_corpus(stream, length_encoder, path, f"documents-{uuid.uuid4().hex}")
    run.awaitTermination()
    return encoded(corpora.read_corpus(t.spark, path))


@query("select count(*) as n_before, cast(0 as bigint) as n_after from embeddings")
def cleared_corpus(t: Tables):
    path = fresh_path(t, "corpus")
    corpora.write_corpus(t.embeddings, path)
    before = corpora.read_corpus(t.spark, path).count()
    corpora.clear_corpus(t.spark, path)
    after = corpora.read_corpus(t.spark, path).agg(F.count(F.lit(1)).alias("n_after"))
    return after.select(F.lit(before).cast("long").alias("n_before"), "n_after")


# -- sinks -------------------------------------------------------------------------

@query(f"with {FIVE} select query_id, doc_id as positive_id, negative_id from mined")
def stored_training_set(t: Tables):
    path = fresh_path(t, "training-set")
    sinks.write_training_set(shape_negatives(mined_five(t), "triplet"), path)
    return sinks.read_training_set(t.spark, path)


RANKED_RESULT = f"""with {JUDGMENTS} select {r('label')} as label, {r('score / 2')} as ctr,
  {r('score')} as "cosine-score", query_id as query, doc_id as title, pos as "searchOrder",
  row_number() over (partition by query_id order by score desc, pos) as "newOrder" from judgments"""


def ranked_rows(t: Tables) -> DataFrame:
    return rank_within_query(judgments(t)).select(
        "label", (F.col("score") / F.lit(2.0)).alias("ctr"), F.col("score").alias("cosine_score"),
        F.col("query_id").alias("query"), F.col("doc_id").alias("title"),
        F.col("pos").alias("search_order"), "new_order",
    )


@query(RANKED_RESULT)
def ranked_result_as_parquet(t: Tables):
    path = fresh_path(t, "ranked")
    sinks.write_ranked(ranked_rows(t), path)
    return t.spark.read.parquet(path)


@query(RANKED_RESULT)
def ranked_result_as_csv(t: Tables):
    path = fresh_path(t, "ranked")
    rows = ranked_rows(t)
    sinks.write_ranked(rows, path, "csv")
    return t.spark.read.option("header", True).schema(sinks.ranked_result(rows).schema).csv(path)


@query(f"with {TURNS} select anchor_id, md5(anchor) as anchor, md5(positive) as positive from turns")
def question_answer_pairs(t: Tables):
    return turns(t).select("anchor_id", F.md5("anchor").alias("anchor"), F.md5("positive").alias("positive"))
