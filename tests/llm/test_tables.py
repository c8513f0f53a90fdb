"""Shards, mixing, graph search and the pipeline against their defining properties."""

from __future__ import annotations

import collections
import math
import zlib
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from rankloom.llm import graph_index, mixing, packing, sharding
from rankloom.llm.common import stored
from rankloom.llm.components import components
from tests.conftest import SMALL
from tests.llm.common import SCHEMA, no_documents, odd_documents, odd_rows


def test_shards_are_even_though_one_text_has_a_third_of_all_rows(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 50 + 1), "en", "s", 1) for i in range(6000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), shards=16).collect()
    assert len(got) == len(rows)
    loads, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        text = rows[r["doc_id"]][1]
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text.encode()))
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(loads) == set(range(16)) and max(loads.values()) <= 1.02 * min(loads.values())
    assert max(map(len, slots.values())) <= 1.1 * min(map(len, slots.values()))


def test_equal_texts_stay_together_unless_they_are_many(spark):
    rows = [(i, f"text {i // 2}", "en", "s", 1) for i in range(4000)]
    shard = collections.defaultdict(set)
    for r in sharding.shard_documents(spark.createDataFrame(rows, SCHEMA)).collect():
        shard[r["doc_id"] // 2].add(r["shard"])
    assert all(len(s) == 1 for s in shard.values())


def test_shards_of_odd_rows(spark):
    got = sharding.shard_documents(odd_documents(spark, clashes=True)).collect()
    assert len(got) == len(odd_rows())
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 0} == {(1, None)}
    assert sharding.shard_documents(no_documents(spark)).collect() == []


def test_a_source_is_never_a_block_from_its_share():
    weights = {"a": 5.0, "b": 3.0, "c": 1.5, "d": 0.5}
    slots = mixing.whole_weights(weights, 1024)
    assert sum(slots.values()) == 1024
    order = {}
    for source, places in mixing.one_period(slots, 1024).items():
        order |= dict.fromkeys(places, source)
    assert sorted(order) == list(range(1024))
    done = collections.Counter()
    for slot in range(1024):
        done[order[slot]] += 1
        for source, share in slots.items():
            assert abs(done[source] - (slot + 1) * share / 1024) < 1


@pytest.mark.parametrize("weights", [None, {"src0": 3, "src1": 1}])
def test_mixing_places_every_row_once(spark, weights):
    got = mixing.mix(odd_documents(spark, clashes=True), weights, block_rows=3, period=16).collect()
    assert sorted(r["position"] for r in got) == list(range(len(odd_rows())))
    blocks = collections.defaultdict(set)
    for r in got:
        blocks[r["slot"]].add((r["source"], r["block"]))
    assert sorted(blocks) == list(range(len(blocks))) and all(len(b) == 1 for b in blocks.values())
    assert mixing.mix(no_documents(spark)).collect() == []


def test_mixed_order_keeps_rows_and_shares(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 4 else "small", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, {"big": 1, "small": 1}, block_rows=10, period=64).collect()
    first = [r["source"] for r in got if r["position"] < 1000]
    assert abs(first.count("small") - 500) <= 10
    mixed = mixing.in_mixed_order(odd_documents(spark))
    assert collections.Counter(map(tuple, mixed.collect())) == collections.Counter(odd_rows())


def graph_recall(spark, vectors, k=10, **how):
    df = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    index = graph_index.build_index(df, **how)
    rows = graph_index.search(index, df.filter("vec_id % 20 = 0"), k=k).collect()
    data, hits, asked = np.asarray(vectors, np.float32).astype(float), 0, 0
    for q in range(0, len(vectors), 20):
        exact = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        exact[q] = np.inf
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, min(k, len(vectors) - 1) + 1))
        assert all(math.isclose(r["score"], exact[r["vec_id"]], abs_tol=1e-9) for r in mine)
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        best = set(np.lexsort((np.arange(len(data)), exact))[:k].tolist())
        hits, asked = hits + len(best & {r["vec_id"] for r in mine}), asked + len(mine)
    return hits / asked


def test_graph_search_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(5)
    assert graph_recall(spark, rng.normal(size=(1500, 32)), shard_rows=400) >= 0.95
    spread = np.repeat(rng.normal(size=(20, 16)) * 10, 40, axis=0) + rng.normal(size=(800, 16))
    assert graph_recall(spark, spread, shard_rows=300) >= 0.95
    assert graph_recall(spark, rng.normal(size=(5, 8))) == 1


def test_graph_search_leaves_odd_vectors_out(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]),
        (100, [None, 1.0]), (120, [1.0]), (140, []), (None, [1.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = graph_index.search(graph_index.build_index(df), df.filter("vec_id % 20 = 0")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 2)]
    empty = df.limit(0)
    assert graph_index.search(graph_index.build_index(empty), empty).collect() == []


def test_shards_do_not_add_to_the_plan_or_the_tasks_of_a_search(spark):
    rows = [(i, [math.sin(i * 7 + j) for j in range(4)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = graph_index.build_index(df, shard_rows=16)
    shards = index.count()
    got = graph_index.search(index, df.filter("vec_id % 20 = 0"), k=3, block_rows=8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert shards > 40 and str(shards) not in plan and "Broadcast" not in plan
    data = np.array([v for _, v in rows])
    found = got.collect()
    assert len(found) == 150
    hits = 0
    for q in range(0, 1000, 20):
        away = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        away[q] = np.inf
        best = set(np.argsort(away, kind="stable")[:3].tolist())
        hits += len(best & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hits >= 0.9 * 150


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(100, 160)] + [tuple(map(int, rng.integers(0, 90, 2))) for _ in range(60)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in parent if x not in alone}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        seen[name] = out.count()
    assert set(seen) == {"toxicity", "line dedup", "near dedup", "mixing", "packing"}
    assert min(seen["line dedup"], seen["mixing"], seen["near dedup"]) > 0.7 * docs.count()
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_pipeline_stages_take_odd_rows(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SMALL).count() > 0, name
        assert stage(spark, no_documents(spark), SMALL).count() == 0, name


def test_sequences_follow_the_mixed_order(spark):
    """Any prefix of sequences has the target shares up to one group of pieces."""
    rows = [(i, f"w{i % 7} " * 60, "en", "big" if i % 8 else "small", 1) for i in range(8000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)

    def shares(mixed):
        packed = packing.pack_documents(
            stored(mixed, "test-mixed"), corpus_pipeline.vocabulary("word_bpe_49k.json"),
            capacity=512, in_order=True, group_items=200).collect()
        assert sorted(r["doc_id"] for r in packed) == list(range(8000))
        room = collections.Counter()
        for r in packed:
            room[r["sequence_id"]] += r["length"]
        assert max(room.values()) <= 512
        small = [r["doc_id"] % 8 == 0 for r in sorted(packed, key=lambda r: r["sequence_id"])]
        return np.cumsum(small)

    weights = {"big": 3, "small": 1}  # small is used up after 4,000 documents
    got = shares(mixing.in_mixed_order(docs, weights=weights, block_rows=10))
    seen = np.arange(1, 4001)
    assert np.abs(got[:4000] - seen / 4)[:3800].max() <= 200
    plain = shares(docs.orderBy("doc_id"))
    assert np.abs(plain[:4000] - seen / 4)[:3800].max() > 400


def test_the_mixing_stage_changes_the_sequences(spark):
    rows = [(i, f"w{i} " * 300, "en", "big" if i % 8 else "small", 1) for i in range(2000)]
    docs = stored(spark.createDataFrame(rows, SCHEMA).orderBy("doc_id"), "test-docs")
    mixed = stored(corpus_pipeline.mix_sources(spark, docs, SMALL), "test-mixed")

    def sources(table):
        packed = corpus_pipeline.pack(spark, table, SMALL).orderBy("sequence_id", "offset").collect()
        return [rows[r["doc_id"]][3] for r in packed]

    target = 250 ** 0.5 / (250 ** 0.5 + 1750 ** 0.5)
    with_it, without = (sources(t)[:800].count("small") / 800 for t in (mixed, docs))
    assert abs(with_it - target) < 0.05 < abs(without - target)


@pytest.mark.parametrize("weights", [
    [40_000 ** 0.5, 900_000 ** 0.5, 11 ** 0.5, 3_000_000 ** 0.5, 77 ** 0.5, 1_500_000 ** 0.5, 560_000 ** 0.5],
    [0.0005, 0.9995], [1.0], [1, 1, 1], [0.01] * 10 + [0.5, 0.2, 0.2], [1e-4, 3e-4, 0.123, 0.4, 0.4766]])
@pytest.mark.parametrize("length", [64, 1024])
def test_shares_hold_against_the_target_weights_over_many_periods(weights, length):
    plan = mixing.Pfair(mixing.exact_shares(weights), max(length, 4 * len(weights)))
    taken, state = [], [0] * len(weights)
    while len(taken) < 40_000:
        for k, j in plan.run(state, len(taken)):
            state[k] = j + 1
            taken.append((k, j))
    done = np.zeros((len(taken), len(weights)))
    done[np.arange(len(taken)), [k for k, _ in taken]] = 1
    done = np.cumsum(done, axis=0)
    assert all(done[i, k] == j + 1 for i, (k, j) in enumerate(taken))
    shares = [Fraction(w) for w in weights]
    for k, w in enumerate(shares):  # in fractions: the bound is strict
        assert all(abs(int(n) * sum(shares) - slot * w) < sum(shares) for slot, n in enumerate(done[:, k], 1))


@pytest.mark.parametrize("few", [True, False])
def test_a_mixed_table_holds_its_target_weights(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 0)
    docs = spark.range(12_000).selectExpr(
        "id as doc_id", "case when id < 9000 then 'a' when id < 11990 then 'b' else 'c' end as source")
    weights = {"a": 0.7495, "b": 0.25, "c": 0.0005}
    rows = mixing.mix(docs, weights, block_rows=1, period=16).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(12_000)) == [r["slot"] for r in rows]
    alive = next(i for i, r in enumerate(rows) if r["source"] == "b" and r["index"] == 2989)
    for source, share in weights.items():
        done = np.cumsum([r["source"] == source for r in rows[:alive + 1]])
        assert np.abs(done - share * np.arange(1, alive + 2)).max() < 1
    for r in mixing.mix(docs, {"a": 1, "b": 1, "c": 0}, block_rows=7).collect():
        assert r["source"] != "c" or r["position"] >= 11_990


def test_pairs_of_a_small_table_and_middling_groups_stay_together(spark):
    texts = [f"pair {i // 2}" for i in range(400)] + ["group of ten"] * 10 + [f"lone {i}" for i in range(90)]
    for shards, texts in ((2, texts), (16, ["copies"] * 90 + [f"lone {i} text" for i in range(7910)])):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
        got = sharding.shard_documents(docs, shards=shards).collect()
        where, slots = collections.defaultdict(set), collections.defaultdict(list)
        for r in got:
            where[texts[r["doc_id"]]].add(r["shard"])
            slots[r["shard"]].append(r["slot"])
        assert all(len(s) == 1 for s in where.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_few_copies_of_a_very_long_text_are_split(spark):
    texts = ["long " * 20_000] * 4 + [f"short text {i}" for i in range(6000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = sharding.shard_documents(docs, shards=8).collect()
    assert len({r["shard"] for r in got if r["doc_id"] < 4}) == 4


def test_graph_search_finds_copies(spark):
    rng = np.random.default_rng(11)
    groups = [2, 3, 12, 40, 150, 400]
    copies = np.repeat(rng.normal(size=(len(groups), 16)), groups, axis=0)
    mixed = rng.permutation(np.vstack([copies, rng.normal(size=(700, 16))]))
    assert graph_recall(spark, mixed, shard_rows=300) >= 0.98
    assert graph_recall(spark, 1000 + mixed / 1000, shard_rows=300) >= 0.98
    assert graph_recall(spark, np.ones((200, 4)), shard_rows=300) == 1
