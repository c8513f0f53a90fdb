"""The operators as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import (
    digests, graph_index, html_regions, line_runs, minmax, mixing, packing, prefix_trie, records, secret_scan, sharding,
    structure_repair, toxicity,
)
from rankloom.llm.common import fresh_folder, whole_text


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "token-records")
    index = records.write_records(
        _documents(spark, sf_dir), folder, vocabulary("byte_bpe_50k.json"), end_id=0)
    return records.digests(index, folder).join(records.starts(index), "part").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        _documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_documents(spark, sf_dir), rate=0.01)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"),
        secret_scan.written(F.col("all")).alias("spans"),
    )


def op4_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "n_tokens",
    )


def op7_quartile_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.digest_with_next(_documents(spark, sf_dir))


def op8_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(_documents(spark, sf_dir), threshold=85, words=5)


def op9_pruned_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = graph_index.build_index(vectors)
    return graph_index.search(index, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir), block_rows=64, temperature=0.5)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.drop_frequent_lines(
        _documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(whole_text(), 256).alias("kept_sha256"),
    )


def op11_region_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_regions.extract(pages, html_regions.fit(pages, labelled_pages=2_000))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie.prefix_trie(conversations).drop("x", "y")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.damage_and_repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP6_SQL = r"""
with docs as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
lines as (
  select row, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i
  from (select row, doc_id, string_split(text, chr(10)) as ls from docs)
),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
),
frequent as (
  select key from keyed where length(key) >= 1
  group by key having count(distinct row) >= 10
)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(f.key) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where f.key is null), '')) as kept_sha256
from keyed k left join frequent f on k.key = f.key
group by row
"""

def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII string: eight shifts for each character."""
    start = f"list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint))"
    byte = ("list_reduce(list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, i: "
            "case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)")
    return f"xor(list_reduce({start}, lambda crc, c: {byte}), 4294967295::bigint)"


OP12_SQL = rf"""
with convs as (
  select conv_id, {_crc32("conv_id::varchar")} % 4 as h, conv_id - conv_id % 20 as donor
  from (select distinct conv_id from conversations where conv_id is not null)
),
turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as pos
  from conversations
),
offered as (select conv_id as donor, count(*) as n from turns group by conv_id),
rebuilt as (
  select c.conv_id, t.pos as depth, t.role, t.text
  from convs c join turns t on t.conv_id = c.donor and t.pos <= c.h
  union all
  select c.conv_id, least(c.h, coalesce(o.n, 0)) + t.pos - c.h, t.role, t.text
  from convs c join turns t on t.conv_id = c.conv_id and t.pos > c.h left join offered o on o.donor = c.donor
),
steps as (
  select conv_id, depth, len(list_filter(string_split_regex(text, '[ 	-
]+'), lambda w: w <> '')) as words,
    string_agg(md5(md5(role) || md5(text)), ',') over (partition by conv_id order by depth) as key
  from rebuilt
  union all
  select conv_id, 0, 0, '' from convs
),
paths as (
  select *, lag(key) over (partition by conv_id order by depth) as parent,
    depth = max(depth) over (partition by conv_id) as last
  from steps
),
nodes as (
  select key, depth, parent, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(words) as own,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where last), '') as ends
  from paths group by key, depth, parent
),
children as (select parent, count(*) as n from nodes where parent is not null group by parent),
below as (
  select distinct a.key as top, b.key from paths a join paths b on a.conv_id = b.conv_id and b.depth >= a.depth
),
sums as (
  select top, sum(n.own)::bigint as saved, count(*) filter (where c.n is null) as leaves
  from below b join nodes n on n.key = b.key left join children c on c.parent = b.key group by top
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children,
  s.leaves as n_leaves, s.saved as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n left join nodes p on p.key = n.parent left join children c on c.parent = n.key join sums s on s.top = n.key
"""

# The grammar's states 0 to 3 are: start, after s, after u, after a. FORCED is where a row put in leads, as ROLE.
FORCED, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")


def _rest(cost: str, audit: str, lines: str) -> str:
    return f"{{'c': {cost}, 'a': {audit}, 'r': {lines}}}"


def _first_edit(state: int) -> str:
    """SQL for the best rest of a conversation that begins with an edit of the row ``f``, not an insertion."""
    to, role = FORCED[state], ROLE[state]
    legal = {0: "f.initial in ('s', 'u')", 1: "f.initial = 'u'", 2: "f.initial = 'a'", 3: "f.initial = 'u'"}[state]
    keep = "case when f.initial = 's' then s1 when f.initial = 'u' then s2 else s3 end"
    ways = [
        _rest(f"s{state}.c + 3", f"'D' || s{state}.a", f"s{state}.r"),
        _rest(f"case when gone then 1000000000 else s{to}.c + 2 + extra end", f"'R' || s{to}.a",
              f"chr(10) || '{role}:' || f.text || s{to}.r"),
        _rest(f"case when gone or not ({legal}) then 1000000000 else ({keep}).c + extra end", f"'K' || ({keep}).a",
              f"chr(10) || f.role || ':' || f.text || ({keep}).r"),
    ]
    return f"list_min([{', '.join(ways)}])"


def _with_insertions(state: int) -> str:
    """SQL for the best rest with up to three rows put in front."""
    ways, at, letters, lines = [f"b{state}"], state, "", ""
    for n in range(1, 4):
        lines += f"chr(10) || '{ROLE[at]}:' || "
        at, letters = FORCED[at], letters + "I"
        ways.append(_rest(f"b{at}.c + {2 * n}", f"'{letters}' || b{at}.a", f"{lines}b{at}.r"))
    return f"list_min([{', '.join(ways)}])"


OP13_SQL = rf"""
with recursive base as (
  select coalesce(conv_id::varchar, ' ') as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind
  from conversations
),
damaged as (
  select conv, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(case when kind = 3 then [0, 1] else [0] end) as copy
  from base where kind <> 0
),
placed as (select *, row_number() over (partition by conv order by turn nulls first, role, text, copy) as pos from damaged),
seen as (
  select *, row_number() over (partition by conv, role, text order by pos) > 1 as again, left(role, 1) as initial,
    regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) as final,
    left(role, 1) || lead(left(role, 1)) over (partition by conv order by pos) as pair
  from placed
),
faults as (
  select *, case when final = '' then 'blank' when again then 'duplicate'
    when final not in ('.', '!', '?') then 'truncated' else '' end as fault,
    final = '' or again as gone, case when final in ('.', '!', '?') then 0 else 1 end as extra
  from seen
),
counts as (
  select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated,
    count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal, max(pos) as n
  from faults group by conv
),
best as (
  select conv, n + 1 as pos, {_rest("0", "''", "''")} as s0,
    {_rest("4", "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'")} as s1,
    {_rest("2", "'I'", "chr(10) || 'assistant:'")} as s2, {_rest("0", "''", "''")} as s3
  from counts
  union all
  select conv, pos, {', '.join(f'{_with_insertions(state)} as s{state}' for state in range(4))}
  from (
    select f.conv, f.pos, {', '.join(f'{_first_edit(state)} as b{state}' for state in range(4))}
    from best join faults f on f.conv = best.conv and f.pos = best.pos - 1)
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(s0.c, 0)::bigint as cost,
  coalesce(s0.a, '') as audit, sha256(substr(coalesce(s0.r, ''), 2)) as repaired_sha256
from (select distinct conv_id from conversations) c
  left join counts k on k.conv = coalesce(c.conv_id::varchar, ' ')
  left join best b on b.conv = k.conv and b.pos = 1
"""

QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_vector_shards": op4_vector_shards,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_quartile_digests": op7_quartile_digests,
    "op8_minmax_near_dedup": op8_minmax_near_dedup,
    "op9_pruned_graph_search": op9_pruned_graph_search,
    "op10_pfair_mixing": op10_pfair_mixing,
    "op11_region_extraction": op11_region_extraction,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_structure_repair": op13_structure_repair,
}
SQL = {"op6_line_dedup": OP6_SQL, "op12_prefix_trie": OP12_SQL, "op13_structure_repair": OP13_SQL}
