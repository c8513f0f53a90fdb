"""Ranking metrics of the judged lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.registry import Tables, query, r
from rankloom.catalog.views import JUDGMENTS, RANKED, judgments, stage1, vector_corpus, VECTORS
from rankloom.operators import metrics
from rankloom.plans.groups import known_groups


def gain_sum(rank: str, k: int | None) -> str:
    within = f" filter (where {rank} <= {k})" if k else ""
    return f"coalesce(sum((pow(2.0, label) - 1) / log2({rank} + 1.0)){within}, 0)"


def ndcg_sql(k: int | None) -> str:
    ideal = gain_sum("ik", k)
    return f"case when {ideal} = 0 then 0.0 else {gain_sum('rk', k)} / {ideal} end"


HITS = RANKED + """,
hits as (
  select *, sum(case when label >= 1 then 1 else 0 end)
              over (partition by query_id order by rk rows unbounded preceding) as hits
  from ranked)"""


def ap_sql(k: int | None, denominator: str = "hits") -> str:
    within = f"label >= 1 and rk <= {k}" if k else "label >= 1"
    below = (
        f"count(*) filter (where {within})" if denominator == "hits"
        else "count(*) filter (where label >= 1)"
    )
    return f"""case when sum(label) = 0 then 0.0
      else coalesce(sum(hits / cast(rk as double)) filter (where {within}) / nullif({below}, 0), 0.0) end"""


RR = "coalesce(1.0 / min(rk) filter (where label >= 1), 0.0)"


@query(f"with {RANKED} select query_id, {r(gain_sum('rk', 10))} as dcg_at_10 from ranked group by query_id")
def dcg_at_10(t: Tables):
    return metrics.dcg(judgments(t), 10)


@query(f"with {RANKED} select query_id, {r(gain_sum('rk', None))} as dcg from ranked group by query_id")
def dcg_whole_list(t: Tables):
    return metrics.dcg(judgments(t))


@query(f"with {RANKED} select query_id, {r(ndcg_sql(10))} as ndcg_at_10 from ranked group by query_id")
def ndcg_at_10(t: Tables):
    return metrics.ndcg(judgments(t), 10)


@query(f"with {RANKED} select query_id, {r(ndcg_sql(None))} as ndcg from ranked group by query_id")
def ndcg_whole_list(t: Tables):
    return metrics.ndcg(judgments(t))


@query(f"""with {RANKED},
cut as (
  select *, row_number() over (partition by query_id order by label desc, doc_id) as ck
  from ranked where rk <= 5)
select query_id, {r("case when sum((pow(2.0, label) - 1) / log2(ck + 1.0)) > 0 then sum((pow(2.0, label) - 1) / log2(rk + 1.0)) / sum((pow(2.0, label) - 1) / log2(ck + 1.0)) else 0.0 end")} as ndcg_at_5
from cut group by query_id""")
def ndcg_truncated_at_5(t: Tables):
    return metrics.ndcg(judgments(t), 5, ideal="truncated")


@query(f"""with {RANKED} select query_id, {r(ndcg_sql(1))} as ndcg_at_1, {r(ndcg_sql(3))} as ndcg_at_3
from ranked group by query_id""")
def ndcg_at_1_and_3(t: Tables):
    return metrics.ndcg(judgments(t), [1, 3])


@query(f"""with {RANKED}, per_query as (select query_id, {ndcg_sql(10)} as v from ranked group by query_id)
select {r("avg(v)")} as mean_ndcg_at_10 from per_query""")
def mean_ndcg_at_10(t: Tables):
    return metrics.mean_ndcg(judgments(t), 10)


@query(f"with {RANKED} select query_id, {r(RR)} as rr from ranked group by query_id")
def reciprocal_rank(t: Tables):
    return metrics.reciprocal_rank(judgments(t))


@query(f"""with {RANKED}, per_query as (select query_id, {RR} as v from ranked group by query_id)
select {r("avg(v)")} as mrr from per_query""")
def mean_reciprocal_rank(t: Tables):
    return metrics.mrr(judgments(t))


@query(f"with {HITS} select query_id, {r(ap_sql(10))} as ap from hits group by query_id")
def average_precision_at_10(t: Tables):
    return metrics.average_precision(judgments(t), 10)


@query(f"with {HITS} select query_id, {r(ap_sql(None, 'all'))} as ap from hits group by query_id")
def average_precision_all_relevant(t: Tables):
    return metrics.average_precision(judgments(t), denominator="all_relevant")


@query(f"""with {HITS}, per_query as (select query_id, {ap_sql(None)} as v from hits group by query_id)
select {r("avg(v)")} as map from per_query""")
def mean_average_precision(t: Tables):
    return metrics.map_score(judgments(t))


@query(f"""with {HITS} select query_id, {r(ndcg_sql(10))} as ndcg_at_10, {r(RR)} as rr, {r(ap_sql(10))} as ap
from hits group by query_id""")
def ranking_report_at_10(t: Tables):
    return metrics.ranking_report(judgments(t), 10)


@query(f"""with {JUDGMENTS}, means as (select *, avg(score) over (partition by query_id) as m from judgments)
select query_id, {r("avg(case when score > m then 1.0 else 0.0 end)")} as precision_above_mean
from means group by query_id""")
def precision_above_mean(t: Tables):
    return metrics.precision_above_mean(judgments(t))


@query(f"""with {RANKED} select query_id,
  {r("count(*) filter (where label >= 1 and rk <= 10) / cast(10 as double)")} as precision
from ranked group by query_id""")
def precision_at_10(t: Tables):
    return metrics.precision_at(judgments(t), 10)


@query(f"""with {RANKED} select query_id,
  {r("coalesce(count(*) filter (where label >= 1 and rk <= 10) / cast(nullif(count(*) filter (where label >= 1), 0) as double), 0.0)")} as recall
from ranked group by query_id""")
def recall_at_10(t: Tables):
    return metrics.recall_at(judgments(t), 10)


@query(f"""with {RANKED} select query_id,
  {r(f"case when {gain_sum('ik', 10)} = 0 then 0.0 else avg(pow(2.0, label) - 1) * sum(1 / log2(ik + 1.0)) filter (where ik <= 10) / {gain_sum('ik', 10)} end")} as ndcg_random
from ranked group by query_id""")
def ndcg_of_random_order(t: Tables):
    return metrics.ndcg_random(judgments(t), 10)


RERANKED = VECTORS + """,
samples as (
  select query_id, doc_id, stage1_rank as pos, case when label = query_id then 1 else 0 end as label,
         -abs(bi_score - 0.3) as cross_score
  from stage1 where stage1_rank <= 30),
wanted as (select cast(label as bigint) as query_id, count(*) as n_positives from embeddings group by label),
orders as (
  select s.*, n_positives, 'base' as evaluator,
         row_number() over (partition by query_id order by pos, doc_id) as rk
  from samples s join wanted using (query_id)
  union all
  select s.*, n_positives, 'reranked' as evaluator,
         row_number() over (partition by query_id order by round(cross_score, 9) desc, pos) as rk
  from samples s join wanted using (query_id)),
counted as (
  select *, sum(label) over (partition by evaluator, query_id order by rk rows unbounded preceding) as hits
  from orders),
per_query as (
  select evaluator, query_id,
    coalesce(sum(1 / log2(rk + 1.0)) filter (where label = 1 and rk <= 10), 0)
      / list_sum(list_transform(range(1, least(max(n_positives), 10) + 1), lambda i: 1 / log2(i + 1.0))) as ndcg,
    coalesce(1.0 / min(rk) filter (where label = 1 and rk <= 10), 0) as rr,
    coalesce(sum(hits / cast(rk as double)) filter (where label = 1), 0) / max(n_positives) as ap
  from counted group by evaluator, query_id),
report as (
  select evaluator, 'ndcg@10' as metric, avg(ndcg) as value from per_query group by evaluator
  union all select evaluator, 'mrr@10', avg(rr) from per_query group by evaluator
  union all select evaluator, 'map', avg(ap) from per_query group by evaluator)"""


def reranked(t: Tables):
    """Thirty mined documents per query, positives left in, with a second score."""
    found = stage1(t, 30)
    labels = vector_corpus(t).select("doc_id", "label")
    wanted = labels.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.count(F.lit(1)).alias("n_positives")
    )
    same = (F.col("label") == F.col("query_id")).cast("int")
    second = F.round(-F.abs(F.col("bi_score") - F.lit(0.3)), 9)
    return found.join(labels, "doc_id").join(wanted, "query_id").select(
        "query_id", "doc_id", F.col("stage1_rank").alias("pos"), same.alias("label"),
        second.alias("cross_score"), "n_positives",
    )


def evaluated(t: Tables):
    documents = reranked(t)
    return metrics.evaluate_reranking(documents, 10, sizes=known_groups(documents, 30))


@query(f"with {RERANKED} select evaluator, metric, {r('value')} as value from report")
def reranking_evaluation(t: Tables):
    return evaluated(t)


@query(f"""with {RANKED},
per_query as (select query_id, {ndcg_sql(10)} as v from ranked group by query_id),
sets as (select cast(query_id % 3 as varchar) as dataset, avg(v) as v from per_query group by 1)
select dataset, {r("v")} as ndcg_at_10 from sets
union all select 'mean', {r("avg(v)")} from sets""")
def evaluation_by_dataset(t: Tables):
    per_query = metrics.ndcg(judgments(t), 10).withColumn("dataset", F.pmod("query_id", F.lit(3)))
    return metrics.evaluate_by_dataset(per_query, "ndcg_at_10")


@query(f"""with {RERANKED}, {RANKED},
judged as (select {ndcg_sql(10)} as v from ranked group by query_id)
select evaluator, metric, {r('value')} as value from report
union all select 'judged', 'ndcg@10', {r('avg(v)')} from judged""")
def combined_evaluation(t: Tables):
    judged = metrics.mean_ndcg(judgments(t), 10).select(
        F.lit("judged").alias("evaluator"), F.lit("ndcg@10").alias("metric"),
        F.col("mean_ndcg_at_10").alias("value"),
    )
    return metrics.combine_reports(evaluated(t), judged)


@query(f"""with {RANKED},
history as (select query_id as round, {ndcg_sql(10)} as ndcg_at_10 from ranked group by query_id)
select round, {r('ndcg_at_10')} as ndcg_at_10 from history order by history.ndcg_at_10 desc, round limit 1""")
def best_round_by_metric(t: Tables):
    history = metrics.ndcg(judgments(t), 10).withColumnRenamed("query_id", "round")
    return metrics.best_iteration(history, "ndcg_at_10")
