"""Quality of pointwise predictions."""

from __future__ import annotations

from rankloom.catalog.registry import Tables, query, r
from rankloom.catalog.views import PREDICTIONS, predictions
from rankloom.operators import quality


@query(f"with {PREDICTIONS} select {r('avg(case when cls = predicted then 1.0 else 0.0 end) * 100')} as accuracy from classed")
def class_accuracy(t: Tables):
    return quality.accuracy(predictions(t), "cls")


@query(f"with {PREDICTIONS} select {r('sqrt(avg(pow(label - logit, 2)))')} as rmse from predictions")
def root_mean_squared_error(t: Tables):
    return quality.rmse(predictions(t), "label", "logit")


@query(f"with {PREDICTIONS} select cls as label, predicted, count(*) as n from classed group by all")
def confusion_matrix(t: Tables):
    return quality.confusion_matrix(predictions(t), "cls")


@query(f"""with {PREDICTIONS},
per_class as (
  select k.cls,
    (select count(*) from classed c where c.cls = k.cls and c.predicted = k.cls) as hits,
    (select count(*) from classed c where c.predicted = k.cls) as predicted,
    (select count(*) from classed c where c.cls = k.cls) as support
  from (select cls from classed union select predicted from classed) k),
scored as (
  select cast(cls as varchar) as cls, hits, support,
    coalesce(hits / cast(nullif(predicted, 0) as double), 0.0) as precision,
    coalesce(hits / cast(nullif(support, 0) as double), 0.0) as recall,
    coalesce(2.0 * hits / nullif(predicted + support, 0), 0.0) as f1
  from per_class),
n as (select cast(sum(support) as bigint) as n, sum(hits) / cast(sum(support) as double) as acc from scored)
select cls, {r('precision')} as precision, {r('recall')} as recall, {r('f1')} as f1, support from scored
union all select 'accuracy', {r('acc')}, {r('acc')}, {r('acc')}, n from n
union all select 'macro avg', {r('avg(precision)')}, {r('avg(recall)')}, {r('avg(f1)')}, max(n) from scored, n
union all select 'weighted avg', {r('sum(precision * support) / max(n)')}, {r('sum(recall * support) / max(n)')},
  {r('sum(f1 * support) / max(n)')}, max(n) from scored, n""")
def classification_report(t: Tables):
    return quality.classification_report(predictions(t), "cls")


RANKS = PREDICTIONS + """,
averaged as (
  select (rank() over (order by label) + (count(*) over (partition by label) - 1) / 2.0) as rx,
         (rank() over (order by logit) + (count(*) over (partition by logit) - 1) / 2.0) as ry, label
  from predictions)"""


@query(f"with {RANKS} select {r('corr(rx, ry)')} as spearman from averaged")
def spearman_correlation(t: Tables):
    return quality.spearman(predictions(t), "label", "logit")


@query(f"with {PREDICTIONS} select {r('corr(label, logit)')} as pearson from predictions")
def pearson_correlation(t: Tables):
    return quality.pearson(predictions(t), "label", "logit")


@query(f"""with {PREDICTIONS},
p as (select row_number() over () as i, label as x, logit as y from predictions),
pairs as (select sign(a.x - b.x) as sx, sign(a.y - b.y) as sy from p a join p b on a.i < b.i)
select {r('sum(sx * sy) / sqrt(sum(abs(sx)) * cast(sum(abs(sy)) as double))')} as kendall from pairs""")
def kendall_correlation(t: Tables):
    return quality.kendall(predictions(t), "label", "logit")


# The p-value is the share of the t density beyond |r|: with r = sin(angle), the
# integral of cos^(n - 3) from that angle to a right angle, by Simpson's rule.
STEPS = 20_000


def tail_integral(start: str) -> str:
    step = f"(pi() / 2 - {start}) / {STEPS}"
    weight = f"case when i in (0, {STEPS}) then 1 when i % 2 = 1 then 4 else 2 end"
    return f"sum({weight} * pow(abs(cos({start} + i * {step})), n - 3)) * max({step}) / 3"


@query(f"""with {RANKS},
found as (
  select 'pearson' as statistic, corr(label, logit) as value, count(*) as n from predictions
  union all select 'spearman', corr(rx, ry), count(*) from averaged),
grid as (select unnest(range(0, {STEPS} + 1)) as i)
select statistic, {r('max(value)')} as value,
  {r(f"({tail_integral('asin(abs(value))')}) / ({tail_integral('0.0')})")} as p_value
from found, grid group by statistic, value, n""")
def correlations_with_p_values(t: Tables):
    return quality.correlation_report(predictions(t), "label", "logit")


@query(f"""with {RANKS},
n as (select count(*) filter (where label = 1) as p, count(*) filter (where label <> 1) as q,
             sum(ry) filter (where label = 1) as s from averaged)
select {r('(s - p * (p + 1) / 2.0) / (cast(p as double) * q)')} as roc_auc from n""")
def roc_area(t: Tables):
    return quality.roc_auc(predictions(t), "label", "logit")


@query(f"""with {PREDICTIONS},
steps as (select logit as threshold, count(*) filter (where label = 1) as p,
                 count(*) filter (where label <> 1) as q from predictions group by logit)
select {r('threshold')} as threshold,
  {r('sum(q) over (order by threshold desc) / cast(sum(q) over () as double)')} as fpr,
  {r('sum(p) over (order by threshold desc) / cast(sum(p) over () as double)')} as tpr
from steps""")
def roc_points(t: Tables):
    return quality.roc_curve(predictions(t), "label", "logit")
