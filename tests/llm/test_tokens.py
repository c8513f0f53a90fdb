"""Token ids, records and packing against plain encoding of whole texts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankloom.llm import packing, records
from rankloom.llm.common import SLICE_ROWS, fresh_folder, kept, trimmed
from rankloom.llm.tokens import Encoder, encoder
from tests.llm.common import no_documents, odd_documents, odd_rows, unique_documents, unique_rows

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def plain(name, plain_added=False):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    if plain_added:
        tokenizer.encode_special_tokens = True
    return lambda text: np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


ENCODERS = {name: (Encoder(public_tokenizers.path(name), kept_words=8), plain(name)) for name in NAMES}
ODD = [
    "it's  ok, don't 's", " lead", "tail\n", "İstanbul. İ. ß ﬁ x", "a\x1cb c", "1234 ab12, x=3;",
    "日本 語。テスト 🙂🙂 a", "é é. क़. ok", "a\tb c d e x", "http://x.y/z?q=1", "²x y². Ⅷ.",
    "a <|endoftext|> b", "<|endoftext|><|startoftext|>", "x<|endoftext|>\n y <|ENDOFTEXT|>", "<|endoftext |>",
]
PARTS = ["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "<|ENDOFTEXT|>", " <|", "|>"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("text", ODD + sorted(set(unique_rows().values())))
def test_ids_of_odd_texts(name, text):
    ours, whole = ENCODERS[name]
    assert ours.ids(text) == whole(text).tobytes()


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB é\n .,'-_1\tß中́ \x1fİ")) | st.characters(codec="utf-8"), max_size=40))
def test_ids_of_any_text(name, text):
    ours, whole = ENCODERS[name]
    assert ours.ids(text) == whole(text).tobytes()


def test_records_round_trip(spark):
    folder, whole = fresh_folder(spark, "records"), plain(NAMES[0])
    index = records.write_records(unique_documents(spark), folder, public_tokenizers.path(NAMES[0]))
    starts = {row["part"]: row["start"] for row in records.starts(index).collect()}
    got = {r["doc_id"]: (starts[r["part"]] + r["before"], r["ids"]) for r in records.read_records(index, folder).collect()}
    at = 0
    for doc_id, text in sorted(unique_rows().items()):
        ids = [*whole(text).tolist(), 0]
        assert got.pop(doc_id) == (at, ids)
        at += len(ids)
    assert not got
    some = index.filter("doc_id % 5 = 0")
    assert {r["doc_id"] for r in records.digests(some, folder).collect()} == {i for i in unique_rows() if i % 5 == 0}


def test_records_of_odd_rows(spark):
    folder = fresh_folder(spark, "records")
    index = records.write_records(odd_documents(spark, clashes=True), folder, public_tokenizers.path(NAMES[0]))
    assert sorted(str(r["doc_id"]) for r in records.digests(index, folder).collect()) == sorted(str(r[0]) for r in odd_rows())
    folder = fresh_folder(spark, "records")
    index = records.write_records(no_documents(spark), folder, public_tokenizers.path(NAMES[0]))
    assert records.digests(index, folder).collect() == []
    assert records.starts(index).collect() == []


def test_damage_is_noticed():
    record = records.framed(b"payload")
    assert records.unframed(record) == b"payload"
    for i in range(len(record)):
        broken = bytearray(record)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            records.unframed(bytes(broken))


def checked(rows, capacity):
    sequences = {}
    for row in rows:
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark):
    whole = plain(NAMES[1])
    rows = packing.pack_documents(
        unique_documents(spark), public_tokenizers.path(NAMES[1]), capacity=64, group_items=100, fan_in=2).collect()
    want = {}
    for doc_id, text in unique_rows().items():
        ids = np.append(whole(text), 0).astype("<u4")
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at:at + 64]
            want[doc_id, piece] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len(rows) == len(want)
    used = checked(rows, 64)
    assert used <= 1.02 * sum(x[1] for x in want.values()) / 64 + 2


def test_packing_of_odd_rows(spark):
    path = public_tokenizers.path(NAMES[1])
    rows = packing.pack_documents(odd_documents(spark, clashes=True), path).collect()
    assert sorted(str(r["doc_id"]) for r in rows if not r["piece"]) == sorted(str(r[0]) for r in odd_rows())
    checked(rows, 2048)
    assert packing.pack_documents(no_documents(spark), path).collect() == []


@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
def test_best_fit(sizes):
    bins, offsets = packing.best_fit(np.array(sizes), 50)
    total = np.bincount(bins, weights=sizes)
    assert total.max() <= 50 and sorted(total + np.roll(total, 1))[0] >= 0
    for b in set(bins.tolist()):
        here = sorted((offsets[i], sizes[i]) for i in range(len(sizes)) if bins[i] == b)
        assert [o for o, _ in here] == [sum(s for _, s in here[:i]) for i in range(len(here))]
    assert (total <= 25).sum() <= 1


def test_encoders_are_given_back_by_operators_without_one():
    first = encoder(public_tokenizers.path(NAMES[1]), 8)
    list(trimmed(lambda batches: iter([encoder(public_tokenizers.path(NAMES[1]), 8)]), keeps=True)([]))
    assert first in kept().values() and encoder(public_tokenizers.path(NAMES[1]), 8) is first
    list(trimmed(lambda batches: batches)(iter([])))
    assert not kept()


def test_trimmed_runs_see_all_rows_in_short_batches():
    rows = pa.RecordBatch.from_arrays([pa.array(range(2 * SLICE_ROWS + 3))], ["x"])
    seen = list(trimmed(lambda batches: batches)(iter([rows, rows.slice(0, 0), rows.slice(5, 1)])))
    assert max(map(len, seen)) == SLICE_ROWS
    assert [x for batch in seen for x in batch[0].to_pylist()] == [*rows[0].to_pylist(), 5]


def test_packing_is_the_same_with_few_kept_words(spark):
    docs = unique_documents(spark).coalesce(1)
    path = public_tokenizers.path(NAMES[1])
    few, many = (
        sorted(packing.pack_documents(docs, path, 64, in_order=True, **kept_words).collect())
        for kept_words in ({"kept_words": 8}, {}))
    assert few == many and few
