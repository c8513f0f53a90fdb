"""Retrieval and re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.registry import QUERIES, Tables, fresh_path, query, r
from rankloom.catalog.views import (
    VECTORS, lexical, stage1, vector_corpus, vector_queries,
)
from rankloom.operators import retrieval
from rankloom.operators.cells import HyperplaneCells, KMeansCells, recall, walsh_planes
from rankloom.operators.inverted_file import InvertedFile
from rankloom.operators.pairs import make_pairs
from rankloom.operators.scorers import HashedTfIdf, embed, lexical_score

CANDIDATES = VECTORS + f""",
candidates as (
  select s.query_id, s.doc_id, s.bi_score, s.stage1_rank, b.text as query, d.text as document
  from stage1 s left join documents d using (doc_id) left join benchmark b on b.item_id = s.query_id
  where s.stage1_rank <= 20),
crossed as (select *, {lexical('query', 'document')} as cross_score from candidates),
final as (
  select *, row_number() over (partition by query_id order by cross_score desc, stage1_rank) as final_rank
  from crossed)"""

RESULT = f"""query_id, doc_id, {r('bi_score')} as bi_score, cast(stage1_rank as integer) as stage1_rank,
  {r('cross_score')} as cross_score, cast(final_rank as integer) as final_rank"""
COLUMNS = ["query_id", "doc_id", "bi_score", "stage1_rank", "cross_score", "final_rank"]


@query(f"with {VECTORS} select query_id, doc_id, {r('bi_score')} as bi_score from scored_docs")
def cosine_scores(t: Tables):
    return retrieval.cosine_scores(vector_queries(t), vector_corpus(t))


@query(f"""with {VECTORS} select query_id, doc_id, {r('bi_score')} as bi_score,
  cast(stage1_rank as integer) as stage1_rank from stage1 where stage1_rank <= 20""")
def retrieve_top_20(t: Tables):
    return stage1(t, 20)


@query(f"""with {CANDIDATES} select query_id, doc_id, cast(length(query) as integer) as query_chars,
  cast(length(document) as integer) as document_chars from candidates""")
def candidate_text_pairs(t: Tables):
    pairs = _candidates(t)
    return pairs.select(
        "query_id", "doc_id", F.length("query").alias("query_chars"),
        F.length("document").alias("document_chars"),
    )


def _candidates(t: Tables):
    asked = vector_queries(t)
    found, shape = retrieval.retrieve_counted(asked, vector_corpus(t), 20)
    return make_pairs(found, asked, t.documents, shape.n * 20)


@query(f"with {CANDIDATES} select {RESULT} from final")
def rerank_all_candidates(t: Tables):
    return retrieval.rerank(_candidates(t), lexical_score, largest=20).select(*COLUMNS)


@query(f"with {CANDIDATES} select {RESULT} from final where final_rank <= 3")
def rerank_top_3(t: Tables):
    return retrieval.rerank(_candidates(t), lexical_score, 3).select(*COLUMNS)


@query(f"with {CANDIDATES} select {RESULT} from final where final_rank <= 5")
def two_stage_top_5(t: Tables):
    found = retrieval.two_stage(
        vector_queries(t), vector_corpus(t), lexical_score, texts=t.documents
    )
    return found.select(*COLUMNS)


@query(QUERIES["retrieve_top_20"].sql)
def retrieve_with_every_cell_probed(t: Tables):
    """Sixteen cells, all of which every query looks into: exact again."""
    every = HyperplaneCells(64, bits=4, radius=4)
    return retrieval.retrieve(vector_queries(t), vector_corpus(t), 20, every)


@query(QUERIES["retrieve_top_20"].sql)
def retrieve_by_inverted_file(t: Tables):
    """Stored by cells, searched until the bounds certify the result."""
    index = InvertedFile.build(vector_corpus(t), fresh_path(t, "inverted-file"), n_cells=16)
    return index.search(vector_queries(t), 20).select(
        "query_id", "doc_id", "bi_score", F.col("stage1_rank").cast("int").alias("stage1_rank"))


@query(f"""with {VECTORS},
signs as (
  select b, owner, id, sum(x * case when bit_count((place & (2 * b + 1))::integer) % 2 = 1 then -1 else 1 end) > 0 as up
  from (
    select 'query' as owner, query_id as id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as place
    from vector_queries
    union all
    select 'document', doc_id, unnest(embedding), generate_subscripts(embedding, 1) - 1 from vector_corpus), range(6) as t(b)
  group by b, owner, id),
near as (
  select q.id as query_id, d.id as doc_id from signs q join signs d on q.b = d.b
  where q.owner = 'query' and d.owner = 'document'
  group by q.id, d.id having count(*) filter (where q.up <> d.up) <= 1),
ranked as (
  select query_id, doc_id, bi_score, row_number() over (partition by query_id order by bi_score desc, doc_id) as place
  from scored_docs join near using (query_id, doc_id))
select query_id, doc_id, {r('bi_score')} as bi_score, cast(place as integer) as stage1_rank from ranked where place <= 20""")
def retrieve_by_given_planes(t: Tables):
    """Approximate search whose planes follow a rule: documents at most one sign away."""
    cells = HyperplaneCells(64, radius=1, planes=walsh_planes(64, 6))
    return retrieval.retrieve(vector_queries(t), vector_corpus(t), 20, cells)


# Other approximate search has no SQL: its cells come from training or from random planes.

def _kmeans(t: Tables):
    return KMeansCells.fit(vector_corpus(t), n_cells=16, n_probe=6)


@query()
def retrieve_by_kmeans_cells(t: Tables):
    return retrieval.retrieve(vector_queries(t), vector_corpus(t), 20, _kmeans(t))


@query()
def retrieve_by_hyperplane_cells(t: Tables):
    return retrieval.retrieve(vector_queries(t), vector_corpus(t), 20, HyperplaneCells(64))


@query()
def recall_of_kmeans_cells(t: Tables):
    found = retrieval.retrieve(vector_queries(t), vector_corpus(t), 20, _kmeans(t))
    return recall(found, stage1(t, 20))


def _encoded(t: Tables):
    documents = t.documents.select("doc_id", "text")
    encoder = HashedTfIdf.fit(documents)
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return embed(queries, encoder), embed(documents, encoder)


@query()
def embedded_documents(t: Tables):
    _, corpus = _encoded(t)
    squares = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x)
    return corpus.select("doc_id", F.size("embedding").alias("dims"), F.sqrt(squares).alias("norm"))


@query()
def text_search_two_stage(t: Tables):
    queries, corpus = _encoded(t)
    return retrieval.two_stage(queries, corpus, lexical_score).select(*COLUMNS)
