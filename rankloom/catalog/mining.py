"""Pairs, in-batch negatives and mined negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.registry import Tables, fresh_path, query, r
from rankloom.catalog.views import (
    JUDGMENTS, POSITIVES, RANKED, TURNS, VECTORS, judgments, lexical, positives, seeded,
    seeded_number, turns, vector_corpus, vector_queries,
)
from rankloom.operators import mining
from rankloom.operators.inverted_file import InvertedFile
from rankloom.operators.pairs import all_pairs, in_batch_negatives, pair_counts, preference_pairs
from rankloom.operators.scorers import lexical_score
from rankloom.sources.datasets import assign_batches, batches_without_duplicates

# Batch size and seed of the training runs.
BATCH, SEED = 64, 12


@query(f"""with {JUDGMENTS}, labels as (select query_id, label, count(*) as n from judgments group by all)
select query_id, cast(sum(n) * sum(n) as bigint) as all_pairs,
  (select count(*) from judgments a join judgments b on a.query_id = b.query_id and a.label > b.label
   where a.query_id = labels.query_id) as preference_pairs
from labels group by query_id""")
def pair_counts_per_query(t: Tables):
    return pair_counts(judgments(t))


PAIR = """a.query_id, a.doc_id as doc_id_i, b.doc_id as doc_id_j, cast(a.rk as integer) as rank_i,
  cast(b.rk as integer) as rank_j from ranked a join ranked b on a.query_id = b.query_id
  and a.rk <= 10 and b.rk <= 10"""
PAIR_COLUMNS = ["query_id", "doc_id_i", "doc_id_j", "rank_i", "rank_j"]


@query(f"with {RANKED} select {PAIR} and a.label > b.label")
def preference_pairs_at_10(t: Tables):
    return preference_pairs(judgments(t), 10).select(*PAIR_COLUMNS)


@query(f"with {RANKED} select {PAIR}")
def all_pairs_at_10(t: Tables):
    return all_pairs(judgments(t), 10).select(*PAIR_COLUMNS)


# -- in-batch negatives ----------------------------------------------------------

BATCHED = TURNS + f""",
batched as (
  select *, {seeded_number(SEED, 'anchor_id')} % cast(ceil((select count(*) from turns) / {BATCH}.0) as bigint) as batch_id
  from turns)"""


def draw(t: int, offered: str) -> str:
    return f"({seeded_number(SEED, 'anchor_id', str(t))} % greatest({offered} - {t}, 1))"


# Draws without replacement: each draw steps over the numbers taken before it, lowest first.
NEGATIVES = BATCHED + f""",
numbered as (
  select *, row_number() over (partition by batch_id order by anchor_id) as rk,
         count(*) over (partition by batch_id) - 1 as others
  from batched),
draw1 as (select *, [{draw(0, 'others')}] as taken from numbered),
draw2 as (select * exclude (taken), list_sort(list_append(taken,
  list_reduce(taken, lambda x, s: case when s <= x then x + 1 else x end, {draw(1, 'others')}))) as taken from draw1),
draw3 as (select * exclude (taken), list_sort(list_append(taken,
  list_reduce(taken, lambda x, s: case when s <= x then x + 1 else x end, {draw(2, 'others')}))) as taken from draw2),
draw4 as (select * exclude (taken), list_sort(list_append(taken,
  list_reduce(taken, lambda x, s: case when s <= x then x + 1 else x end, {draw(3, 'others')}))) as taken from draw3),
drawn as (
  select batch_id, anchor_id, anchor, positive, rk,
         unnest(case when others <= 4 then range(0, others) else taken end) as d
  from draw4),
picks as (
  select *, case when d + 1 >= rk then d + 2 else d + 1 end as other_rk from drawn),
negatives as (
  select p.batch_id, p.anchor_id, p.anchor, p.positive, n.anchor_id as negative_owner, n.positive as negative
  from picks p join numbered n on n.batch_id = p.batch_id and n.rk = p.other_rk)"""


def batched_turns(t: Tables):
    return assign_batches(turns(t), BATCH, SEED, "anchor_id")


def batched_negatives(t: Tables):
    batched = batched_turns(t)
    return batched, in_batch_negatives(batched, 4, SEED)


@query(f"with {BATCHED} select anchor_id, cast(batch_id as bigint) as batch_id from batched")
def assigned_batches(t: Tables):
    return batched_turns(t).select("anchor_id", "batch_id")


@query(f"""with {TURNS} select anchor_id, cast((row_number() over (
    order by {seeded(SEED, 'anchor_id')}, anchor_id) - 1) // {BATCH} as bigint) as batch_id from turns""")
def assigned_exact_batches(t: Tables):
    batched = assign_batches(turns(t), BATCH, SEED, "anchor_id", exact=True)
    return batched.select("anchor_id", "batch_id")


@query(f"""with copies as (select text, count(*) as n from documents group by text),
needed as (select greatest(ceil(sum(n) / {BATCH}), max(n)) as batches from copies)
select doc_id, cast((row_number() over (order by md5(text), {seeded(SEED, 'doc_id')}, doc_id) - 1) % batches as bigint) as batch_id
from documents, needed""")
def batches_of_distinct_texts(t: Tables):
    return batches_without_duplicates(t.documents, BATCH, SEED, "doc_id", "text").select("doc_id", "batch_id")



@query(f"with {NEGATIVES} select batch_id, anchor_id, negative_owner, md5(negative) as negative_md5 from negatives")
def sampled_in_batch_negatives(t: Tables):
    found = batched_negatives(t)[1]
    return found.select(
        "batch_id", "anchor_id", "negative_owner", F.md5("negative").alias("negative_md5")
    )


# -- mined negatives ---------------------------------------------------------------

def mined_sql(n: int, low: int, high: int, margin: float | None, keep_positives: bool = False, order: str = "s.stage1_rank") -> str:
    """CTEs for mined negatives; ``order`` sorts the candidates of a pair."""
    foreign = "" if keep_positives else " and s.label <> s.query_id"
    within = f" and s.bi_score <= own.bi_score - {margin}::double" if margin is not None else ""
    return f"""{VECTORS}, {POSITIVES},
near as (
  select p.query_id, p.doc_id, s.doc_id as negative_id, s.bi_score, s.stage1_rank,
         {order} as sort_key
  from positives p
  join stage1 own on own.query_id = p.query_id and own.doc_id = p.doc_id
  join stage1 s on s.query_id = p.query_id and s.stage1_rank > {low} and s.stage1_rank <= {high}{foreign}{within}),
chosen as (
  select *, row_number() over (partition by query_id, doc_id order by sort_key) as choice from near),
mined as (
  select *, row_number() over (partition by query_id, doc_id order by stage1_rank) as place
  from chosen where choice <= {n})"""


MINED = f"""query_id, doc_id, negative_id, {r('bi_score')} as negative_score,
  cast(stage1_rank as integer) as negative_rank, cast(place as integer) as place from mined"""


def mined(t: Tables, **options):
    return mining.mine_hard_negatives(positives(t), vector_queries(t), vector_corpus(t), **options)


@query(f"with {mined_sql(5, 0, 100, 0.0)} select {MINED}")
def hard_negatives(t: Tables):
    return mined(t, num_negatives=5, range_max=100, absolute_margin=0.0)


@query(f"with {mined_sql(5, 0, 100, 0.0)} select {MINED}")
def hard_negatives_by_index(t: Tables):
    """The same through an inverted file, by certified search."""
    index = InvertedFile.build(vector_corpus(t), fresh_path(t, "inverted-file"), n_cells=16)
    return mined(t, num_negatives=5, range_max=100, absolute_margin=0.0, index=index)


@query(f"with {mined_sql(3, 10, 60, 0.05)} select {MINED}")
def hard_negatives_in_range(t: Tables):
    return mined(t, num_negatives=3, range_min=10, range_max=60, absolute_margin=0.05)


@query(f"""with {mined_sql(3, 0, 50, None, order=seeded(SEED, 'p.query_id', 'p.doc_id', 's.doc_id'))} select {MINED}""")
def hard_negatives_at_random(t: Tables):
    return mined(t, num_negatives=3, range_max=50, sampling="random", seed=SEED)


@query(f"with {mined_sql(30, 0, 100, None, keep_positives=True)} select {MINED}")
def evaluation_lists_with_positives(t: Tables):
    return mined(t, num_negatives=30, range_max=100, include_positives=True)


FIVE = mined_sql(5, 0, 100, 0.0)


def mined_five(t: Tables):
    return mined(t, num_negatives=5, range_max=100, absolute_margin=0.0)


@query(f"""with {FIVE} select query_id, doc_id, cast(1 as integer) as label from positives
union all select query_id, negative_id, 0 from mined""")
def negatives_as_labeled_pairs(t: Tables):
    return mining.shape_negatives(mined_five(t), "labeled-pair", pairs=positives(t))


@query(f"with {FIVE} select query_id, doc_id as positive_id, negative_id from mined")
def negatives_as_triplets(t: Tables):
    return mining.shape_negatives(mined_five(t), "triplet")


@query(f"""with {FIVE} select query_id, doc_id as positive_id, string_agg(negative_id, ',' order by place) as negatives
from mined group by query_id, doc_id having count(*) = 5""")
def negatives_as_tuples(t: Tables):
    shaped = mining.shape_negatives(mined_five(t), "n-tuple")
    joined = F.array_join(F.col("negatives").cast("array<string>"), ",")
    return shaped.select("query_id", "positive_id", joined.alias("negatives"))


@query(f"""with {FIVE} select p.query_id, p.doc_id || coalesce(',' || string_agg(m.negative_id, ',' order by m.place), '') as docs,
  '1' || repeat(',0', count(m.place)::bigint) as labels
from positives p left join mined m on m.query_id = p.query_id and m.doc_id = p.doc_id
group by p.query_id, p.doc_id""")
def negatives_as_labeled_lists(t: Tables):
    shaped = mining.shape_negatives(mined_five(t), "labeled-list", pairs=positives(t))
    return shaped.select(
        "query_id",
        F.array_join(F.col("docs").cast("array<string>"), ",").alias("docs"),
        F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"),
    )


@query(f"""with {FIVE}, complete as (select count(*) as n from mined where place = 5)
select count(*) as pairs, count(*) - max(n) as short from positives, complete""")
def pairs_with_too_few_negatives(t: Tables):
    return mining.short_tuples(mined_five(t), positives(t))


@query(f"""with {FIVE},
texts as (
  select m.query_id, m.doc_id, m.negative_id, b.text as q, p.text as p, n.text as n
  from mined m left join benchmark b on b.item_id = m.query_id
  left join documents p on p.doc_id = m.doc_id left join documents n on n.doc_id = m.negative_id)
select query_id, doc_id as positive_id, negative_id,
  {r(f"({lexical('q', 'p')}) - ({lexical('q', 'n')})")} as margin from texts""")
def teacher_margins_of_triplets(t: Tables):
    texts = t.documents.select("doc_id", "text")
    triplets = (
        mining.shape_negatives(mined_five(t), "triplet")
        .join(texts.select(F.col("doc_id").alias("positive_id"), F.col("text").alias("positive")), "positive_id", "left")
        .join(texts.select(F.col("doc_id").alias("negative_id"), F.col("text").alias("negative")), "negative_id", "left")
        .join(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id", "left")
    )
    scored = mining.teacher_margins(triplets, lexical_score)
    return scored.select("query_id", "positive_id", "negative_id", "margin")
