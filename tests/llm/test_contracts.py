"""The registered queries on the small tables, against brute force written from their contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rankloom.llm.queries import QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SMALL).collect()]


def ids_of(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: np.asarray([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")


def test_op1(spark, texts):
    encode, at, want = ids_of("byte_bpe_50k.json"), 0, {}
    for doc_id in sorted(texts):
        ids = encode(texts[doc_id])
        want[doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(spark, "op1_token_records")} == want


def test_op2(spark, texts):
    encode, capacity = ids_of("word_bpe_49k.json"), 2048
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op2_best_fit_packing"):
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    total = 0
    for doc_id, own in pieces.items():
        ids = encode(texts[doc_id])
        total += len(ids)
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            part = ids[r["piece"] * capacity:(r["piece"] + 1) * capacity]
            assert (r["start"], r["length"], r["ids_crc32"]) == (r["piece"] * capacity, len(part), zlib.crc32(part.tobytes()))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.02 * total / capacity + 1


def found_secrets(text):
    """(kind, start, end) of the base patterns, by Python's own expressions."""
    kinds = {
        "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8),
        "access": (r"AKIA[A-Z0-9]+", 16), "hex": (r"[0-9a-f]+", 32),
    }
    out = []
    for order, (kind, (pattern, least)) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            if len(m[1] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def test_op3(spark, texts):
    for r in rows(spark, "op3_secret_scan"):
        found = found_secrets(texts[r["doc_id"]])
        kinds = [kind for kind, _, _ in found]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        written = ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(written.split(",")) - {""} <= set(r["spans"].split(","))


def test_op4(spark, texts):
    shards, found = defaultdict(list), rows(spark, "op4_vector_shards")
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        shards[r["shard"]].append(r)
    assert sorted(shards) == list(range(16))
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in own) for own in shards.values()]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in found)


def test_op7(spark, texts):
    order = sorted(texts, reverse=True)
    after = {doc_id: order[(i + 1) % len(order)] for i, doc_id in enumerate(order)}
    found = {r["doc_id"]: r for r in rows(spark, "op7_quartile_digests")}
    by_text = defaultdict(set)
    for doc_id, r in found.items():
        text, other = texts[doc_id], texts[after[doc_id]]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + other[:cut]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[text].add(r["fingerprint"])
        if edited == text:
            assert r["near_edited"] == 1 and r["edited_fingerprint"] == r["fingerprint"]
    assert all(len(prints) == 1 for prints in by_text.values())
    assert np.mean([r["near_edited"] for r in found.values()]) > 0.1 + np.mean([r["near_next"] for r in found.values()])


def test_op9(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table}
    found, hits, wanted = defaultdict(list), 0, 0
    for r in rows(spark, "op9_pruned_graph_search"):
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in vectors if i % 100 == 0}
    for query, got in found.items():
        got.sort()
        exact = sorted((np.linalg.norm(v - vectors[query]), i) for i, v in vectors.items() if i != query)[:10]
        assert [rank for rank, _, _ in got] == list(range(1, 11))
        for _, vec_id, score in got:
            assert score == pytest.approx(np.linalg.norm(vectors[vec_id] - vectors[query]), abs=1e-12)
        assert [(s, i) for _, i, s in got] == sorted((s, i) for _, i, s in got)
        hits += len({i for _, i, _ in got} & {i for _, i in exact})
        wanted += 10
    assert hits >= 0.9 * wanted


def test_op10(spark, texts):
    found = rows(spark, "op10_pfair_mixing")
    assert sorted(r["position"] for r in found) == list(range(len(texts)))
    per_block = defaultdict(set)
    for r in found:
        per_block[r["slot"]].add((r["source"], r["block"]))
    assert all(len(own) == 1 for own in per_block.values())
