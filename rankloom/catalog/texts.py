"""Scalar functions over texts, labels and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.registry import Tables, query, r
from rankloom.catalog.views import (
    JUDGMENTS, PREDICTIONS, RANKED, TEXT_PAIRS, judgments, lexical, overlap, predictions,
    text_pairs, tok,
)
from rankloom.functions import rank_math as rm
from rankloom.functions import text as tx
from rankloom.operators.ranking import positions, softmax_in_query
from rankloom.operators.scorers import extract_features, lexical_score, score_pairs

# Fixed value: the keyword counted in the given texts.
KEYWORD = "tion"


def keyword_sql(text: str) -> str:
    return (
        f"cast((length({text}) - length(replace(lower({text}), '{KEYWORD}', ''))) "
        f"// {len(KEYWORD)} as integer)"
    )


@query(f"select item_id, cast(len({tok('text')}) as integer) as query_tokens from benchmark")
def query_token_count(t: Tables):
    return t.benchmark.select("item_id", tx.token_count(F.col("text")).alias("query_tokens"))


@query(f"select doc_id, cast(len({tok('text')}) as integer) as document_tokens from documents")
def document_token_count(t: Tables):
    return t.documents.select("doc_id", tx.token_count(F.col("text")).alias("document_tokens"))


@query(f"""with {TEXT_PAIRS} select doc_id, cast({overlap('query', 'document')} as integer) as common_tokens
from text_pairs""")
def token_overlap(t: Tables):
    return text_pairs(t).select(
        "doc_id", tx.token_overlap(F.col("query"), F.col("document")).alias("common_tokens")
    )


@query(f"""with {TEXT_PAIRS} select doc_id, {keyword_sql('query')} as query_keyword,
  {keyword_sql('document')} as document_keyword from text_pairs""")
def keyword_count(t: Tables):
    return text_pairs(t).select(
        "doc_id",
        tx.keyword_count(F.col("query"), KEYWORD).alias("query_keyword"),
        tx.keyword_count(F.col("document"), KEYWORD).alias("document_keyword"),
    )


@query(f"""with {TEXT_PAIRS} select query_id, doc_id,
  concat_ws(',', len({tok('query')}), len({tok('document')}), {overlap('query', 'document')},
            {keyword_sql('query')}, {keyword_sql('document')}) as features
from text_pairs""")
def pair_feature_vectors(t: Tables):
    features = extract_features(text_pairs(t), KEYWORD)
    return features.select(
        "query_id", "doc_id", F.array_join(F.col("features").cast("array<string>"), ",").alias("features")
    )


@query(f"with {PREDICTIONS} select doc_id, predicted from classed")
def bucketized_predictions(t: Tables):
    return predictions(t).select("doc_id", "predicted")


@query("""select doc_id, case when length(text) > 50 then substr(text, 1, 50) || '...' else text end as preview,
  substr(text, 1, 80) || '...' as dotted from documents""")
def text_preview(t: Tables):
    text = F.col("text")
    return t.documents.select(
        "doc_id", tx.preview(text).alias("preview"), tx.preview(text, 80, always=True).alias("dotted")
    )


@query(f"""with {PREDICTIONS} select doc_id, {r('logit')} as plain,
  {r('1 / (1 + exp(-logit))')} as sigmoid from predictions""")
def activations(t: Tables):
    x = F.col("logit")
    return predictions(t).select(
        "doc_id", rm.activate(x, "identity").alias("plain"), rm.activate(x, "sigmoid").alias("sigmoid")
    )


@query(f"""with {RANKED} select doc_id, {r('pow(2.0, label) - 1')} as gain, {r('log2(rk + 1.0)')} as discount
from ranked""")
def gain_and_discount(t: Tables):
    return positions(judgments(t)).select(
        "doc_id", rm.gain(F.col("label")).alias("gain"), rm.discount(F.col("rank")).alias("discount")
    )


@query(f"""with {PREDICTIONS} select doc_id, {r('greatest(logit, 0.0)')} as at_least_0,
  {r('least(greatest(logit, -1.0), 1.0)')} as within_1 from predictions""")
def clamped_scores(t: Tables):
    x = F.col("logit")
    return predictions(t).select(
        "doc_id", rm.clamp(x, low=0.0).alias("at_least_0"), rm.clamp(x, -1.0, 1.0).alias("within_1")
    )


@query(f"""with {JUDGMENTS}, tops as (select *, max(score) over (partition by query_id) as m from judgments)
select doc_id, {r('exp(score - m) / sum(exp(score - m)) over (partition by query_id)')} as softmax from tops""")
def softmax_of_scores(t: Tables):
    return softmax_in_query(judgments(t), "score").select("doc_id", "softmax")


@query(f"with {JUDGMENTS} select doc_id, label >= 1 as relevant from judgments")
def relevance_flag(t: Tables):
    return judgments(t).select("doc_id", rm.is_relevant(F.col("label")).alias("relevant"))


@query(f"with {TEXT_PAIRS} select query_id, doc_id, {r(lexical('query', 'document'))} as score from text_pairs")
def lexical_pair_scores(t: Tables):
    return score_pairs(text_pairs(t), lexical_score).select("query_id", "doc_id", "score")
