"""Losses of the scored lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.catalog.mining import NEGATIVES, batched_negatives
from rankloom.catalog.registry import QUERIES, Tables, query, r
from rankloom.catalog.views import JUDGMENTS, PREDICTIONS, judgments, lexical, predictions
from rankloom.functions import dual
from rankloom.operators import gradients, losses
from rankloom.operators.scorers import lexical_score, score_pairs

SIGMOID = "(1 / (1 + exp(-logit)))"
BINARY = JUDGMENTS + ", binary_labels as (select logit, least(label, 1.0) as y from judgments)"


def binary(t: Tables):
    return judgments(t).withColumn("label", F.least("label", F.lit(1.0)))


def bce_sql(weight: float, label: str = "y") -> str:
    return r(f"avg(-({weight} * {label} * ln({SIGMOID}) + (1 - {label}) * ln(1 - {SIGMOID})))")


@query(f"with {BINARY} select {bce_sql(1.0)} as loss from binary_labels")
def binary_cross_entropy(t: Tables):
    return losses.bce_loss(binary(t))


@query(f"with {BINARY} select {bce_sql(5.0)} as loss from binary_labels")
def binary_cross_entropy_weighted(t: Tables):
    return losses.bce_loss(binary(t), pos_weight=5.0)


@query(f"""with {PREDICTIONS} select {r('''avg(ln(exp(logit) + exp(-logit) + exp(logit / 2))
  - case cls when 0 then logit when 1 then -logit else logit / 2 end)''')} as loss from predictions""")
def multi_class_cross_entropy(t: Tables):
    x = F.col("logit")
    logits = F.array(x, -x, x / F.lit(2.0))
    return losses.ce_loss(predictions(t).select(logits.alias("logits"), F.col("cls").alias("label")))


@query(f"with {JUDGMENTS} select {r('avg(pow(logit - label, 2))')} as loss from judgments")
def mean_squared_error(t: Tables):
    return losses.mse_loss(judgments(t))


@query(f"with {JUDGMENTS} select {r(f'avg(pow({SIGMOID} - label, 2))')} as loss from judgments")
def mean_squared_error_of_sigmoid(t: Tables):
    return losses.mse_loss(judgments(t), activation="sigmoid")


def margin_rows(t: Tables):
    """Each judged document against two weaker scores, with raw teacher scores."""
    x, y = F.col("logit"), F.col("label")
    return judgments(t).select(
        "doc_id", x.alias("pos_logit"), F.array(x / 2.0, x / 4.0).alias("neg_logits"),
        F.array(y, y / 2.0, y / 4.0).alias("teacher"),
    )


@query(f"""with {JUDGMENTS} select {r('''avg((pow(logit / 2 - label / 2, 2)
  + pow(logit * 0.75::double - label * 0.75::double, 2)) / 2)''')} as loss from judgments""")
def margin_mean_squared_error(t: Tables):
    return losses.margin_mse_loss(margin_rows(t))


@query(f"""with {JUDGMENTS} select doc_id, {r('label / 2')} as first_margin, {r('label * 0.75::double')} as second_margin
from judgments""")
def normalized_margins(t: Tables):
    margins = losses.normalize_margins(margin_rows(t))
    return margins.select(
        "doc_id", F.element_at("margins", 1).alias("first_margin"),
        F.element_at("margins", 2).alias("second_margin"),
    )


LISTNET = JUDGMENTS + """,
shares as (
  select query_id, exp(label) / sum(exp(label)) over w as p, logit - ln(sum(exp(logit)) over w) as lq
  from judgments window w as (partition by query_id)),
listnet as (select query_id, -sum(p * lq) as loss from shares group by query_id)"""


@query(f"with {LISTNET} select query_id, {r('loss')} as loss from listnet")
def listnet_per_query(t: Tables):
    return losses.listnet_per_query(judgments(t))


@query(f"with {LISTNET} select {r('avg(loss)')} as loss from listnet")
def listnet(t: Tables):
    return losses.listnet_loss(judgments(t))


def listmle_sql(weighted: bool, order: str = "pos", pad_to: int | None = None, weight: str | None = None) -> str:
    pad = f"(greatest({pad_to} - n, 0) * exp(1e-16::double)) + " if pad_to else ""
    w = weight or ("pow(2.0, n - i0) - 1" if weighted else "1.0")
    total = "sum(w) + 1e-10" if weighted or weight else "1.0"
    return f"""with {JUDGMENTS},
listed as (
  select query_id, logit, count(*) over (partition by query_id) as n,
         row_number() over (partition by query_id order by {order}) - 1 as i0,
         sum(exp(logit)) over (partition by query_id order by {order}
                               rows between current row and unbounded following) as tail
  from judgments),
likelihood as (select query_id, {w} as w, logit - ln({pad}tail + 1e-10) as lp from listed),
per_query as (select query_id, -sum(w * lp) / ({total}) as loss from likelihood group by query_id)
select {r('avg(loss)')} as loss from per_query"""


@query(listmle_sql(True))
def plistmle(t: Tables):
    return losses.plistmle_loss(judgments(t))


@query(listmle_sql(True, "label desc, pos"))
def plistmle_by_label(t: Tables):
    return losses.plistmle_loss(judgments(t), respect_input_order=False)


@query(listmle_sql(True, pad_to=100))
def plistmle_padded(t: Tables):
    return losses.plistmle_loss(judgments(t), pad_to=100)


@query(listmle_sql(False, weight="1 / log2(i0 + 2.0)"))
def plistmle_custom_discount(t: Tables):
    return losses.plistmle_loss(
        judgments(t), weight=lambda rank: F.lit(1.0) / F.log2(rank + F.lit(1.0))
    )


@query(listmle_sql(False))
def listmle(t: Tables):
    return losses.listmle_loss(judgments(t))


@query(listmle_sql(False, "label desc, pos"))
def listmle_by_label(t: Tables):
    return losses.listmle_loss(judgments(t), respect_input_order=False)


WEIGHTS = {
    "none": "1.0",
    "ndcg1": "a.g / a.d",
    "ndcg2": "case when a.rk = b.rk then 0.0 else abs(1 / log2(abs(a.rk - b.rk) + 1.0) - 1 / log2(abs(a.rk - b.rk) + 2.0)) end * abs(a.g - b.g)",
    "lambdarank": "abs(1 / a.d - 1 / b.d) * abs(a.g - b.g)",
}
WEIGHTS["own"] = "abs(a.g - b.g) / sqrt(a.rk * b.rk + 1.0)"
WEIGHTS["ndcg2pp"] = f"10.0 * {WEIGHTS['ndcg2']} + {WEIGHTS['lambdarank']}"


def gains_sql(k: int | None, score: str = "logit") -> str:
    within = f" filter (where ik <= {k})" if k else ""
    return f"""{JUDGMENTS},
placed as (
  select *, row_number() over (partition by query_id order by {score} desc, doc_id) as rk,
         row_number() over (partition by query_id order by label desc, doc_id) as ik
  from judgments),
gains as (
  select *, log2(1.0 + rk) as d,
    (pow(2.0, greatest(label, 0)) - 1) / greatest(coalesce(sum((pow(2.0, greatest(label, 0)) - 1) / log2(1.0 + ik)){within}
      over (partition by query_id), 0), 1e-10) as g
  from placed)"""


def lambda_sql(scheme: str, k: int | None = None, log: str = "log2") -> str:
    better = "" if scheme == "ndcg1" else " and a.label > b.label"
    first = f" and a.rk <= {k} and b.rk <= {k}" if k else ""
    return f"""with {gains_sql(k)},
pairs as (
  select {WEIGHTS[scheme]} as w,
         greatest(1 / (1 + exp(-greatest(least(a.logit - b.logit, 1e8), -1e8))), 1e-10) as p
  from gains a join gains b on a.query_id = b.query_id{better}{first})
select {r(f"-avg({log}(greatest(pow(p, w), 1e-10)))")} as loss from pairs"""


@query(lambda_sql("none"))
def lambda_loss_unweighted(t: Tables):
    return losses.lambda_loss(judgments(t), "none")


@query(lambda_sql("ndcg1", 10))
def lambda_loss_ndcg1_at_10(t: Tables):
    return losses.lambda_loss(judgments(t), "ndcg1", k=10)


@query(lambda_sql("ndcg1"))
def lambda_loss_ndcg1(t: Tables):
    return losses.lambda_loss(judgments(t), "ndcg1")


@query(lambda_sql("ndcg2"))
def lambda_loss_ndcg2(t: Tables):
    return losses.lambda_loss(judgments(t), "ndcg2")


@query(lambda_sql("lambdarank"))
def lambda_loss_lambdarank(t: Tables):
    return losses.lambda_loss(judgments(t), "lambdarank")


@query(lambda_sql("ndcg2pp"))
def lambda_loss_ndcg2pp(t: Tables):
    return losses.lambda_loss(judgments(t))


def root_of_ranks(gain_i, gain_j, rank_i, rank_j):
    """A weighting scheme of our own."""
    return np.abs(gain_i - gain_j) / np.sqrt(rank_i * rank_j + 1.0)


@query(lambda_sql("own"))
def lambda_loss_own_scheme(t: Tables):
    return losses.lambda_loss(judgments(t), root_of_ranks)


@query(lambda_sql("ndcg2pp", 10, "ln"))
def lambda_loss_at_10_natural_log(t: Tables):
    return losses.lambda_loss(judgments(t), k=10, log="natural")


@query(lambda_sql("none", 10))
def ranknet_at_10(t: Tables):
    return losses.ranknet_loss(judgments(t), k=10)


@query(f"""with {gains_sql(None, 'score')},
pairs as (
  select a.query_id, a.doc_id as i, b.doc_id as j, 1 / (1 + exp(a.score - b.score)) as rho,
         abs(a.g - b.g) * abs(1 / a.d - 1 / b.d) as w
  from gains a join gains b on a.query_id = b.query_id and a.label > b.label),
pulls as (
  select query_id, i as doc_id, rho * w as l, rho * (1 - rho) * w as h from pairs
  union all select query_id, j, -rho * w, rho * (1 - rho) * w from pairs),
summed as (select query_id, doc_id, sum(l) as l, sum(h) as h from pulls group by query_id, doc_id)
select g.query_id, g.doc_id, {r('coalesce(l, 0)')} as lambda, {r('coalesce(h, 0)')} as hessian
from gains g left join summed s using (query_id, doc_id)""")
def lambda_gradients(t: Tables):
    found = gradients.lambda_gradients(judgments(t))
    return found.select("query_id", "doc_id", "lambda", "hessian")


# -- in-batch negatives ----------------------------------------------------------

MNRL = NEGATIVES + f""",
candidates as (
  select batch_id, anchor_id, anchor_id as candidate, true as is_positive, anchor, positive as passage from batched
  union all
  select batch_id, anchor_id, negative_owner, false, anchor, negative from negatives),
scored as (
  select *, 2 * ({lexical('anchor', 'passage')}) - 0.5::double as logit from candidates),
zs as (select *, 10 * {SIGMOID} as z from scored),
sums as (
  select anchor_id, ln(sum(exp(z))) - max(z) filter (where is_positive) as loss from zs group by anchor_id)"""


def candidate_texts(t: Tables):
    """Each anchor with its positive and its in-batch negatives."""
    batched, negatives = batched_negatives(t)
    own = batched.select(
        "batch_id", "anchor_id", F.col("anchor_id").alias("candidate_id"),
        F.lit(True).alias("is_positive"), "anchor", F.col("positive").alias("passage"),
    )
    others = negatives.select(
        "batch_id", "anchor_id", F.col("negative_owner").alias("candidate_id"),
        F.lit(False).alias("is_positive"), "anchor", F.col("negative").alias("passage"),
    )
    return own.unionByName(others)


def scored_passages(candidates):
    scored = score_pairs(candidates, lexical_score, "anchor", "passage", "logit")
    return scored.withColumn("logit", F.lit(2.0) * F.col("logit") - F.lit(0.5))


def scored_candidates(t: Tables):
    return scored_passages(candidate_texts(t))


@query(f"with {MNRL} select {r('avg(loss)')} as loss from sums")
def in_batch_negatives_loss(t: Tables):
    return losses.mnrl_loss(scored_candidates(t))


@query(f"""with {MNRL},
per_batch as (select batch_id, count(*) as n from batched group by batch_id)
select anchor_id, candidate as candidate_id, {r('''(exp(z) / sum(exp(z)) over (partition by anchor_id)
  - case when is_positive then 1 else 0 end) * 10 * ''' + SIGMOID + ' * (1 - ' + SIGMOID + ') / n')} as gradient
from zs join per_batch using (batch_id)""")
def in_batch_negatives_gradients(t: Tables):
    found = losses.mnrl_logit_gradients(scored_candidates(t))
    return found.select("anchor_id", "candidate_id", "gradient")


# With hard negatives: the answers that follow the next two questions of the same conversation.
HARD = MNRL.split("sums as (")[0].rstrip().removesuffix(",").replace("scored as (", f"""hard as (
  select batch_id, anchor_id, anchor,
    unnest([lead(positive) over w, lead(positive, 2) over w]) as passage, unnest([-1, -2]) as candidate
  from batched window w as (partition by anchor_id // 100 order by anchor_id)),
every_candidate as (
  select * from candidates
  union all select batch_id, anchor_id, candidate, false, anchor, passage from hard where passage is not null),
scored as (""").replace("from candidates)", "from every_candidate)").replace(f"10 * {SIGMOID} as z", "tanh(logit) as z")


def with_hard_ones(t: Tables):
    batched, _ = batched_negatives(t)
    following = Window.partitionBy(F.floor(F.col("anchor_id") / 100)).orderBy("anchor_id")
    rows = batched.withColumns({"near": F.lead("positive").over(following), "far": F.lead("positive", 2).over(following)})
    every = losses.with_hard_negatives(candidate_texts(t), rows, {"near": -1, "far": -2})
    return scored_passages(every)


@query(f"""with {HARD},
sums as (select anchor_id, ln(sum(exp(z))) - max(z) filter (where is_positive) as loss from zs group by anchor_id)
select {r('avg(loss)')} as loss from sums""")
def in_batch_loss_with_hard_negatives(t: Tables):
    """Another activation, and no scale."""
    return losses.mnrl_loss(with_hard_ones(t), scale=None, activation="tanh")


@query(f"""with {HARD},
per_batch as (select batch_id, count(*) as n from batched group by batch_id)
select anchor_id, candidate as candidate_id, {r("""(exp(z) / sum(exp(z)) over (partition by anchor_id)
  - case when is_positive then 1 else 0 end) * (1 - tanh(logit) * tanh(logit)) / n""")} as gradient
from zs join per_batch using (batch_id)""")
def in_batch_gradients_with_hard_negatives(t: Tables):
    found = losses.mnrl_logit_gradients(with_hard_ones(t), scale=None, activation=dual.tanh)
    return found.select("anchor_id", "candidate_id", "gradient")


@query(f"""select 'bce' as loss_name, loss from (with {BINARY} select {bce_sql(1.0)} as loss from binary_labels)
union all select 'mse', loss from (with {JUDGMENTS.replace("judgments as", "js as", 1)}
  select {r('avg(pow(logit - least(label, 1.0), 2))')} as loss from js)""")
def loss_comparison(t: Tables):
    return losses.loss_report(binary(t), {"bce": losses.bce_loss, "mse": losses.mse_loss})


COMPARED = {
    "bce": f"with {JUDGMENTS} select {bce_sql(1.0, 'label')} as loss from judgments",
    "mse": QUERIES["mean_squared_error"].sql,
    "listnet": QUERIES["listnet"].sql,
    "listmle": QUERIES["listmle"].sql,
    "plistmle": QUERIES["plistmle"].sql,
    "ranknet": QUERIES["lambda_loss_unweighted"].sql,
    "lambda": QUERIES["lambda_loss_ndcg2pp"].sql,
}


@query(" union all ".join(f"select '{name}' as loss_name, loss from ({sql})" for name, sql in COMPARED.items()))
def all_losses_compared(t: Tables):
    return losses.loss_report(judgments(t))
