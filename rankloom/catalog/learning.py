"""Boosted trees on the judged lists. Training is iterative, so SQL has the first tree and fixed trees only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler

from rankloom.catalog.losing import gains_sql
from rankloom.catalog.registry import Tables, fresh_path, query, r
from rankloom.catalog.views import EVENT_LABELS, one_if
from rankloom.functions.keys import seeded_int
from rankloom.operators.lambdamart import LambdaMART, LambdaMARTModel, decayed_rate, feature_importance
from rankloom.operators.metrics import mean_ndcg
from rankloom.operators.ranker import LambdaMARTRanker, LambdaMARTRankerModel
from rankloom.operators.trees import Node

TREES = 10


def training_rows(t: Tables) -> DataFrame:
    """Judged documents with features: hour, minute, value, property, hour class."""
    label = F.lit(0.0)
    for kind, value in EVENT_LABELS.items():
        label = F.when(F.col("event_type") == kind, F.lit(value)).otherwise(label)
    hour, minute = F.hour("ts"), F.minute("ts")
    prop = F.get_json_object("props", "$.k").cast("double")
    features = F.array(
        hour.cast("double"), minute.cast("double"), F.col("value"), F.coalesce(prop, F.lit(0.0)),
        F.floor(hour / 6).cast("double"),
    )
    return t.events.select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"),
        label.alias("label"), features.alias("features"),
    )


def parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Whole queries for training and for validation."""
    rows = training_rows(t)
    held_out = F.pmod(seeded_int(12, F.col("query_id")), F.lit(5)) == 0
    return rows.where(~held_out), rows.where(held_out)


def unranked(rows: DataFrame) -> float:
    """NDCG@10 of the order without a model."""
    return mean_ndcg(rows.withColumn("score", F.lit(0.0))).first()[0]


def gained(model: LambdaMARTModel, rows: DataFrame, name: str, before: float | None = None) -> DataFrame:
    """NDCG@10 of the model next to that of the order without a model."""
    before = unranked(rows) if before is None else before
    after = mean_ndcg(model.transform(rows)).first()[0]
    return rows.sparkSession.createDataFrame(
        [(name, len(model.trees), float(before), float(after))],
        "model string, trees int, ndcg_before double, ndcg_after double",
    )


@query()
def trained_lambdamart(t: Tables):
    rows = training_rows(t)
    return gained(LambdaMART(n_trees=TREES).fit(rows), rows, "lambdarank")


@query()
def lambdamart_predictions(t: Tables):
    rows = training_rows(t)
    return LambdaMART(n_trees=TREES).fit(rows).transform(rows).select("query_id", "doc_id", "score")


@query()
def regularised_lambdamart(t: Tables):
    rows = training_rows(t)
    trainer = LambdaMART(
        n_trees=TREES, max_depth=4, num_leaves=10, min_leaf_rows=20, max_bins=64, l1=0.5, l2=0.5,
        learning_rate=decayed_rate, query_subsample=0.5, feature_subsample=0.797,
    )
    return gained(trainer.fit(rows), rows, "regularised")


@query()
def categorical_lambdamart(t: Tables):
    rows = training_rows(t)
    return gained(LambdaMART(n_trees=TREES, categorical=[4]).fit(rows), rows, "categorical")


@query()
def watched_lambdamart(t: Tables):
    train, valid = parts(t)
    model = LambdaMART(n_trees=TREES, eval_at=[1, 3], stop_after=5).fit(train, valid)
    best = one_if(F.col("round") == model.best_iteration)
    return model.history_table(t.spark).withColumn("best", best)


@query()
def pointwise_and_pairwise_boosting(t: Tables):
    rows = training_rows(t).withColumn("label", F.least("label", F.lit(1.0)))
    before, reports = unranked(rows), None
    for objective in ("ranknet", "mse", "bce"):
        report = gained(LambdaMART(n_trees=TREES, objective=objective).fit(rows), rows, objective, before)
        reports = report if reports is None else reports.unionByName(report)
    return reports


@query()
def feature_importances(t: Tables):
    model = LambdaMART(n_trees=TREES).fit(training_rows(t))
    return feature_importance(model, t.spark)


@query()
def reloaded_model_predictions(t: Tables):
    rows, path = training_rows(t), fresh_path(t, "model")
    LambdaMART(n_trees=TREES).fit(rows).save(t.spark, path)
    model = LambdaMARTModel.load(t.spark, path)
    return model.transform(rows).select("query_id", "doc_id", "score")


@query()
def leafwise_lambdamart(t: Tables):
    """The larger published settings: 31 leaves of any depth, 512 bins."""
    rows = training_rows(t)
    trainer = LambdaMART(n_trees=TREES, max_depth=None, num_leaves=31, min_leaf_rows=20, max_bins=512, l2=0.5)
    return gained(trainer.fit(rows), rows, "leafwise")


@query()
def pipeline_of_assembler_and_ranker(t: Tables):
    """A pipeline that assembles vectors and ranks, stored and loaded by Spark ML."""
    rows = training_rows(t)
    columns = [f"x{i}" for i in range(5)]
    wide = rows.select("query_id", "doc_id", "label", *[F.col("features")[i].alias(x) for i, x in enumerate(columns)])
    ranker = LambdaMARTRanker(nTrees=TREES, maxDepth=3, numLeaves=8, featuresCol="vector")
    stages = [VectorAssembler(inputCols=columns, outputCol="vector"), ranker]
    path = fresh_path(t, "pipeline")
    Pipeline(stages=stages).fit(wide).write().overwrite().save(path)
    return PipelineModel.load(path).transform(wide).select("query_id", "doc_id", "score")


# -- what SQL can tell: the first tree, and trees that are given --------------------

# The first tree's features have few values, so every value is an edge.
FEW_VALUES = ("hour(ts)", "minute(ts)", "least(floor(value / 10), 10)",
              "coalesce(cast(json_extract_string(props, '$.k') as double), 0)")


def split_sql(name: str, source: str, l2: float = 0.5, least_rows: int = 20) -> str:
    """CTEs that find the best split of the rows (l, h, xs) of ``source``: gain G^2 / (H + l2)."""
    def score(g, h):
        return f"({g}) * ({g}) / (({h}) + {l2})"

    return f"""{name}_scan as (
  select feature, x, sum(g) over w as gl, sum(h) over w as hl, sum(n) over w as nl,
    sum(g) over (partition by feature) as g, sum(h) over (partition by feature) as h, sum(n) over (partition by feature) as n
  from (select feature, x, sum(l) as g, sum(h) as h, count(*) as n
    from (select l, h, unnest(xs) as x, generate_subscripts(xs, 1) - 1 as feature from {source}) group by feature, x)
  window w as (partition by feature order by x)),
{name} as (
  select *, g - gl as gr, h - hl as hr from (
    select *, {score('gl', 'hl')} + {score('g - gl', 'h - hl')} - {score('g', 'h')} as gain from {name}_scan)
  where nl >= {least_rows} and n - nl >= {least_rows} and gain > 0
  order by round(gain / (1e-9 * (select count(*) from rows))) desc, feature, x limit 1)"""


FIRST_TREE = f"""with {gains_sql(None, '0 * score')},
pairs as (
  select a.doc_id as i, b.doc_id as j, 0.5 as rho, abs(a.g - b.g) * abs(1 / a.d - 1 / b.d) as w
  from gains a join gains b on a.query_id = b.query_id and a.label > b.label),
pulls as (
  select i as doc_id, rho * w as l, rho * (1 - rho) * w as h from pairs
  union all select j, -rho * w, rho * (1 - rho) * w from pairs),
summed as (select doc_id, sum(l) as l, sum(h) as h from pulls group by doc_id),
rows as (
  select coalesce(l, 0) as l, coalesce(h, 0) as h, [{', '.join(f'cast({x} as double)' for x in FEW_VALUES)}] as xs
  from events e left join summed s on s.doc_id = e.event_id),
{split_sql('root', 'rows')},
left_rows as (select rows.* from rows, root where xs[feature + 1] <= x),
right_rows as (select rows.* from rows, root where xs[feature + 1] > x),
{split_sql('lower', 'left_rows')},
{split_sql('upper', 'right_rows')}
select node, cast(feature as integer) as feature, cast(threshold as double) as threshold, {r('cast(gain as double)')} as gain,
  {r('cast(value as double)')} as value
from (
  select 0 as node, feature, x as threshold, gain, 0 as value from root
  union all select 1, feature, x, gain, 0 from lower
  union all select 4, feature, x, gain, 0 from upper
  union all select unnest([2, 3]), -1, 0, 0, unnest([gl / (hl + 0.5), gr / (hr + 0.5)]) from lower
  union all select unnest([5, 6]), -1, 0, 0, unnest([gl / (hl + 0.5), gr / (hr + 0.5)]) from upper)"""


@query(FIRST_TREE)
def first_lambdamart_tree(t: Tables):
    rows = training_rows(t).withColumn("features", F.array(
        F.col("features")[0], F.col("features")[1],
        F.least(F.floor(F.col("features")[2] / 10).cast("double"), F.lit(10.0)), F.col("features")[3]))
    trainer = LambdaMART(n_trees=1, max_depth=2, learning_rate=1.0, min_leaf_rows=20, l2=0.5, max_bins=512)
    return trainer.fit(rows).nodes_table(t.spark).select("node", "feature", "threshold", "gain", "value")


def given_trees() -> LambdaMARTModel:
    """Two trees on the training features, one of them with categories."""
    first = [
        Node(feature=2, threshold=50.0, left=1, right=4, gain=9.0), Node(feature=0, threshold=11.0, left=2, right=3, gain=4.0),
        Node(leaf=0, value=0.25), Node(leaf=1, value=-0.125), Node(leaf=2, value=0.5),
    ]
    second = [
        Node(feature=4, categories=[0.0, 3.0], left=1, right=2, gain=2.5), Node(leaf=0, value=0.0625),
        Node(feature=2, threshold=20.0, left=3, right=4, gain=1.5), Node(leaf=1, value=-1.0), Node(leaf=2, value=0.75),
    ]
    return LambdaMARTModel([first, second], 5)


@query(f"""select user_id as query_id, event_id as doc_id,
  {r('''cast(case when value <= 50 then case when hour(ts) <= 11 then 0.25 else -0.125 end else 0.5 end
     + case when floor(hour(ts) / 6) in (0, 3) then 0.0625 when value <= 20 then -1.0 else 0.75 end as double)''')} as score
  from events""")
def scores_of_stored_trees(t: Tables):
    """Given trees as a pipeline stage, written, loaded and applied."""
    path = fresh_path(t, "ranker")
    LambdaMARTRankerModel(given_trees()).write().overwrite().save(path)
    model = LambdaMARTRankerModel.load(path)
    return model.transform(training_rows(t)).select("query_id", "doc_id", "score")


@query("""select name, importance, cast(gain as double) as gain from (values (1, 1, 4.0), (2, 0, 0.0), (3, 2, 10.5), (4, 0, 0.0), (5, 1, 2.5))
  as given(name, importance, gain)""")
def importances_of_stored_trees(t: Tables):
    path = fresh_path(t, "model")
    given_trees().save(t.spark, path)
    used = feature_importance(LambdaMARTModel.load(t.spark, path), t.spark)
    return used.select("name", F.col("importance").cast("int").alias("importance"), "gain")
