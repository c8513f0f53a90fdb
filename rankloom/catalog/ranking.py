"""Positions in ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.judging import HITS
from rankloom.catalog.registry import Tables, query, r
from rankloom.catalog.views import JUDGMENTS, RANKED, VECTORS, judgments, stage1
from rankloom.operators import ranking
from rankloom.plans.groups import known_groups


@query(f"""with {JUDGMENTS} select query_id, doc_id,
  cast(row_number() over (partition by query_id order by score desc, pos) as bigint) as new_order
from judgments""")
def rank_within_query(t: Tables):
    return ranking.rank_within_query(judgments(t)).select("query_id", "doc_id", "new_order")


@query(f"""with {VECTORS},
moved as (
  select query_id, doc_id, stage1_rank,
         row_number() over (partition by query_id order by round(-abs(bi_score - 0.3), 9) desc, stage1_rank)
           as final_rank
  from stage1 where stage1_rank <= 20)
select query_id, doc_id, cast(stage1_rank as integer) as stage1_rank, cast(final_rank as bigint) as final_rank,
  cast(stage1_rank - final_rank as bigint) as rank_change from moved""")
def rank_change(t: Tables):
    second = F.round(-F.abs(F.col("bi_score") - F.lit(0.3)), 9)
    found = stage1(t, 20).withColumn("cross_score", second)
    return ranking.rank_change(found, sizes=known_groups(found, 20)).select(
        "query_id", "doc_id", "stage1_rank", "final_rank", "rank_change"
    )


@query(f"""with {RANKED} select query_id, doc_id, {r('score')} as score, cast(rk as integer) as rank
from ranked where rk <= 5""")
def top_five_per_query(t: Tables):
    return ranking.top_per_query(judgments(t), 5).select("query_id", "doc_id", "score", "rank")


@query(f"""with {RANKED} select query_id, doc_id, cast(rk as bigint) as rank, cast(ik as bigint) as ideal_rank
from ranked""")
def predicted_and_ideal_positions(t: Tables):
    return ranking.positions(judgments(t)).select("query_id", "doc_id", "rank", "ideal_rank")


@query(f"""with {JUDGMENTS},
tops as (select *, greatest(max(logit) over (partition by query_id), 0.0) as shift from judgments)
select query_id, doc_id, {r('''sum(exp(logit - shift)) over (
    partition by query_id order by pos rows between current row and unbounded following)''')} as suffix
from tops""")
def suffix_sums_in_input_order(t: Tables):
    return ranking.suffix_exp_sums(judgments(t)).select("query_id", "doc_id", "suffix")


@query(f"""with {JUDGMENTS},
tops as (select *, greatest(max(logit) over (partition by query_id), 0.0) as shift from judgments)
select query_id, doc_id, {r('''sum(exp(logit - shift)) over (
    partition by query_id order by label desc, pos rows between current row and unbounded following)''')} as suffix
from tops""")
def suffix_sums_by_label(t: Tables):
    return ranking.suffix_exp_sums(judgments(t), by_label=True).select("query_id", "doc_id", "suffix")


@query(f"with {HITS} select query_id, doc_id, cast(rk as bigint) as rank, cast(hits as bigint) as hits from hits")
def running_hit_count(t: Tables):
    return ranking.running_hits(judgments(t)).select("query_id", "doc_id", "rank", "hits")
