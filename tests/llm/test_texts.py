"""Secrets, lines, digests, near duplicates and toxicity against brute force."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from rankloom.llm import digests, line_runs, minmax, queries, secret_scan, toxicity
from rankloom.llm.common import stored
from tests.conftest import SMALL
from tests.llm.common import CLASHES, SCHEMA, no_documents, odd_documents, odd_rows, unique_documents, unique_rows

PATTERNS = (
    re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))


def base_spans(text):
    found = []
    for kind, (pattern, least) in enumerate(zip(PATTERNS, (8, 16, 32), strict=True)):
        for m in pattern.finditer(text):
            if len(m[2] if kind == 0 else m[0]) >= least:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


SECRETS = [
    "token: secret : abcdefghij token=secret=abcdefgh", "🙂 api_key='Ab0/+=.-_9' é AKIA" + "Z" * 12 + " AKIAAKIA12",
    "password: short PassWD = \"longenough1\"", "f" * 31 + " " + "e" * 32 + "g" + "0123456789abcdef" * 4,
    " ".join(f"token={i:08d}" for i in range(700)),
]


def test_base_spans(spark):
    texts = SECRETS + list(unique_rows().values())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in secret_scan.scan(docs).collect():
        want = base_spans(texts[row["doc_id"]])
        assert [tuple(s) for s in row["base"]] == want
        assert [row[f"n_{k}"] for k in secret_scan.KINDS[:3]] == [sum(s[1] == i for s in want) for i in range(3)]
        assert set(map(tuple, row["base"])) <= set(map(tuple, row["all"]))


def test_battery_tells_random_from_prose(spark):
    rng = np.random.default_rng(7)
    letters = secret_scan.UPPER + secret_scan.LOWER + secret_scan.DIGITS + "+/"
    random = ["".join(letters[i] for i in rng.integers(0, 64, 64)) for _ in range(50)]
    words = "there where together another letter between ending reading station".split()
    prose = ["".join(words[i].title() for i in rng.integers(0, len(words), 12))[:64] for _ in range(500)]
    steps = ["ab" * 32, letters, "0123456789" * 6]
    runs = spark.createDataFrame([(x,) for x in {*random, *prose, *steps}], "value string")
    found = {r["value"] for r in secret_scan.discoveries(secret_scan.battery(runs)).collect()}
    assert len(found & set(random)) >= 45
    assert not found & {*prose, *steps}


def test_secrets_of_odd_rows(spark):
    assert secret_scan.scan(odd_documents(spark, clashes=True)).count() == len(odd_rows())
    assert secret_scan.scan(no_documents(spark)).collect() == []


def lines_kept(texts, least, min_chars=1):
    key = lambda line: re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", line).translate(
        str.maketrans(line_runs_upper, line_runs_upper.lower()))
    counts = collections.Counter(k for t in texts for k in {key(x) for x in t.split("\n")})
    kept = [[x for x in t.split("\n") if len(key(x)) < min_chars or counts[key(x)] < least] for t in texts]
    return ["\n".join(x) for x in kept]


line_runs_upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@pytest.mark.parametrize("least", [2, 10])
@pytest.mark.parametrize("few", [True, False])
def test_line_dedup(spark, monkeypatch, least, few):
    if not few:
        monkeypatch.setattr(line_runs, "BROADCAST_KEYS", 0)
    rows = odd_rows()
    texts = [row[1] or "" for row in rows]
    got = line_runs.drop_frequent_lines(odd_documents(spark, clashes=True), least, batches=3, fanout=2).collect()
    want = collections.Counter(zip([r[0] for r in rows], lines_kept(texts, least), strict=True))
    assert collections.Counter((r["doc_id"], r["text"] or "") for r in got) == want
    assert {r[name] for r in got for name in set(CLASHES) - {"n_dropped"}} == {f"own {n}" for n in set(CLASHES) - {"n_dropped"}}
    assert sum(r["n_dropped"] for r in got) > 0
    assert line_runs.drop_frequent_lines(no_documents(spark), least).collect() == []


def test_settled_lines_are_joined_once(spark):
    """However many runs are settled, a batch or a run is joined with them once (Spark puts the join below a merge's union)."""
    runs, plans = line_runs.LineRuns(min_docs=2, fanout=2), []
    runs._run = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, "line-run")
    for batch in range(4):
        keys = [(key, -key, 2 if key == batch else 1) for key in (batch, 10, 20 + batch)]
        runs.add(spark.createDataFrame(keys, "k1 long, k2 long, n long"))
    assert sorted(tuple(r) for r in runs.frequent().collect()) == [(0, 0), (1, -1), (2, -2), (3, -3), (10, -10)]
    assert len(runs.settled) > 2 and max(plan.count("Join LeftAnti") for plan in plans) == runs.fanout


def test_digests(spark):
    rows = {r["doc_id"]: r for r in digests.digest_with_next(unique_documents(spark).repartition(4)).collect()}
    texts = sorted(unique_rows().items(), reverse=True)
    for (doc_id, text), (_, following) in zip(texts, texts[1:] + texts[:1], strict=True):
        row, k = rows[doc_id], len(text) // 3
        changed = text[:len(text) - k] + following[:k]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert row["fingerprint"] == digests.written(digests.codes(text))
        assert row["near_edited"] == digests.likeness(digests.codes(text), digests.codes(changed))
        assert row["near_next"] == digests.likeness(digests.codes(text), digests.codes(following))
    assert len({r["fingerprint"] for r in rows.values() if r["doc_id"] in (6, 7)}) == 1


def test_digests_of_odd_rows(spark):
    assert digests.digest_with_next(odd_documents(spark, clashes=True)).count() == len(odd_rows())
    assert digests.digest_with_next(no_documents(spark)).collect() == []
    one = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    assert digests.digest_with_next(one).first()["near_next"] == 1


def near_classes(texts, threshold=85):
    sets, parent = {}, {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, text in texts.items():
        w = text.encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in texts}


def variants():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for family in range(4):
        base = [words[i] for i in rng.integers(0, 400, 120)]
        for _ in range(12):
            text = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 4)):
                text[at] = words[rng.integers(0, 400)]
            texts[len(texts) + 1000] = " ".join(text)
    return texts


@pytest.mark.parametrize("tile", [3, 1024])
@pytest.mark.parametrize("few", [True, False])
def test_near_duplicates(spark, monkeypatch, tile, few):
    if not few:
        monkeypatch.setattr(minmax, "BROADCAST_IDS", 0)
    texts = unique_rows() | variants()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = minmax.near_duplicates(docs, tile=tile).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_classes(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """A drifting family whose ends are not alike, a family of close copies and strangers that share buckets."""
    monkeypatch.setattr(minmax, "TILE_SHINGLES", 2_000)
    words = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(160):  # each differs from the next by one word, from the far ones by many
        texts[i] = " ".join(f"n{j}" if j < i % 80 else w for j, w in enumerate(words))
    for i in range(120):
        texts[1000 + i] = " ".join(["z"] * 5 + [f"v{j}" if j != i else f"only{i}" for j in range(120)])
    for i in range(30):
        texts[2000 + i] = " ".join(words[:75] + [f"s{i}.{j}" for j in range(60)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = minmax.near_duplicates(docs, tile=16).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_classes(texts)


def test_near_links_are_written_once_and_not_to_a_file_a_task(spark):
    shingles = np.arange(50, dtype=minmax.HASH).tobytes()
    rows = [(bucket, 0, 0, 0, 2 * (bucket % 100) + i, shingles) for bucket in range(300) for i in (0, 1)]
    groups = spark.createDataFrame(rows, "bucket long, one int, two int, tile int, id long, shingles binary")
    links = stored(minmax.confirmed(groups, 85), "near-links")
    assert sorted(map(tuple, links.collect())) == [(2 * i + 1, 2 * i) for i in range(100)]
    assert len(links.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("ids, want", [((1, 2, 3), {1: {1}, 2: {1}, 3: {1}}), ((5, 2, 7), {5: {2, 5}, 2: {2}, 7: {5}})])
def test_near_duplicates_of_an_id_with_two_texts(spark, ids, want):
    x, y = ([f"{side}{i}" for i in range(101)] for side in "xy")
    one, two, three = ids
    rows = [(one, x), (one, y), (two, [*x[:-2], "other", "end"]), (three, [*y[:-2], "other", "end"])]
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in rows], "doc_id long, text string")
    got = {}
    for r in minmax.near_duplicates(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert got == want


def test_near_duplicates_of_odd_rows(spark):
    rows = minmax.near_duplicates(odd_documents(spark, clashes=True)).collect()
    assert len(rows) == len(odd_rows())
    assert {r["component_id"] for r in rows if r["n_shingles"] == 56} == {6}
    assert minmax.near_duplicates(no_documents(spark)).collect() == []


def test_long_texts_are_split_at_white_space(monkeypatch):
    text = "one two  three\tfour five six seven eight nine ten"
    whole = minmax.shingles(text)
    monkeypatch.setattr(minmax, "PIECE", 3)
    assert (minmax.shingles(text) == whole).all()


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    held = [(r["score"], r["toxic"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    toxic, clean = (np.array([s for s, t in held if t == x]) for x in (1, 0))
    assert (toxic[:, None] > clean).mean() > 0.9
    assert (toxic >= 0.5).mean() > 0.7 and (clean >= 0.5).mean() < 0.02


def test_toxicity_of_odd_rows(spark):
    docs = odd_documents(spark, clashes=True)
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scores = toxicity.scored(docs, model)
    assert scores.count() == len(odd_rows()) and scores.columns.count("score") == 1
    assert all(0 <= r["score"] <= 1 for r in scores.collect())
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    nothing = toxicity.fit(no_documents(spark), labels.limit(0))
    assert toxicity.scored(no_documents(spark), nothing).collect() == [] and nothing.score("") == 0.5


def test_label_model_finds_the_better_voter():
    rng = np.random.default_rng(1)
    label = rng.random(20_000) < 0.2
    votes = np.full((len(label), toxicity.VOTERS), "0")
    for j, (hit, miss) in enumerate(((0.9, 0.01), (0.5, 0.02), (0.5, 0.2))):
        votes[:, j] = np.where(rng.random(len(label)) < np.where(label, hit, miss), "+", "0")
    patterns, counts = np.unique(["".join(v) for v in votes], return_counts=True)
    model = toxicity.LabelModel(list(patterns), counts.astype(float), 0.3)
    assert abs(model.share - 0.2) < 0.05
    assert model.given[1, 0, 2] > model.given[1, 1, 2] > model.given[0, 1, 2]


def test_line_query_equals_its_sql(spark):
    from tests.oracle import duck, table_of

    df = queries.QUERIES["op6_line_dedup"](spark, SMALL)
    found = duck(SMALL).execute(queries.SQL["op6_line_dedup"])
    names = [x[0] for x in found.description]
    assert table_of(df.columns, [tuple(r) for r in df.collect()]) == table_of(names, found.fetchall())


def test_line_sql_on_odd_rows(spark, tmp_path):
    """Repeated and null ids, null texts: rows are documents of their own, for the code and for its SQL."""
    import duckdb

    from tests.oracle import table_of

    rows = [(i % 2 + 1, f"shared\nown {i}") for i in range(10)] + [(None, "SHARED \n\nx"), (None, None), (3, ""), (3, None), (4, "a\r\nb\x0b")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    df = queries.QUERIES["op6_line_dedup"](spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{path}/*.parquet'")
    found = connection.execute(queries.SQL["op6_line_dedup"])
    names = [x[0] for x in found.description]
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == table_of(names, found.fetchall())
    assert sum(r[names.index("n_dropped")] for r in df.select(*names).collect()) == 11


def test_near_duplicates_between_80_and_85_percent(spark):
    """One changed word in texts of 50 to 65 words: 0.804 to 0.848; the pipeline's stage drops the copies."""
    rng = np.random.default_rng(4)
    texts = {}
    for length in (48, 50, 55, 60, 65):  # 48 words: 0.796, so both stay
        for _ in range(6):
            words = [f"w{x}" for x in rng.integers(0, 10**9, length)]
            for _ in range(2):
                texts[len(texts)] = " ".join(words)
                words[length // 2] = "other"
    want = near_classes(texts, threshold=80)
    assert {c for i, (_, c) in want.items() if i >= 12} == set(range(12, 60, 2))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()}
    assert kept == {c for _, c in want.values()}


@pytest.mark.parametrize("threshold", [2, 10, 50, 80, 85, 99])
def test_bands_follow_the_threshold(threshold):
    count, bands, width = minmax.layout(threshold)
    assert bands * width <= 2 * count
    assert (1 - (threshold / 100) ** width) ** bands <= 5e-6
    assert minmax.layout(85) == (80, 26, 6)


def test_secrets_within_runs_of_no_single_encoding(spark):
    rng = np.random.default_rng(9)
    draw = lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
    letters = secret_scan.UPPER + secret_scan.LOWER + secret_scan.DIGITS
    forms = [
        ("AWS_ACCESS_KEY_VALUE=", letters + "+/", 64, ""), ("AccountKey=", letters + "+/", 86, "=="),
        ("sig=", letters, 64, ""), ("/v1/x-y/", letters, 64, ""), ("sha512-", letters + "+/", 86, "=="),
        ("a/b=c/x_y/", letters + "-_", 64, ""), ("", secret_scan.UPPER + secret_scan.DIGITS, 80, "")]
    texts, spans = [], []
    for _ in range(8):
        for before, alphabet, n, after in forms:
            texts.append("see " + before + draw(alphabet, n) + after + " there")
            spans.append((4 + len(before), 4 + len(before) + n + len(after)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = collections.Counter()
    for row in secret_scan.scan(docs).collect():
        start, end = spans[row["doc_id"]]
        hits[row["doc_id"] % len(forms)] += any(
            kind == 3 and at <= start and to >= end for at, kind, to in row["all"])
    assert all(hits[i] >= 6 for i in range(len(forms))), hits
