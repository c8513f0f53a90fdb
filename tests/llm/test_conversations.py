"""The prefix trie and the repair of conversations against brute force and SQL."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rankloom.llm import prefix_trie, queries, structure_repair
from tests.conftest import SMALL
from tests.oracle import duck, table_of

SCHEMA = "conv_id long, turn long, role string, text string"


def same_as_sql(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    cursor = duck(SMALL).execute(queries.SQL[name])
    want = table_of([d[0] for d in cursor.description], cursor.fetchall())
    kept = [c for c in df.columns if c in want[0]]
    assert table_of(kept, [tuple(r) for r in df.select(*kept).collect()]) == want


def test_trie_equals_sql(spark):
    same_as_sql(spark, "op12_prefix_trie")


def conversations(rng, n=70):
    """Conversations with shared openings, copies, one long one, and odd rows."""
    texts = ["", None, "one two", "yes. ", "no", "a b c d", " \t"]
    rows = []
    for c in range(n):
        length = rng.choice([1, 1, 2, 3, 4, 6]) if c != 33 else 60
        begin = rng.randrange(3)
        for t in range(length):
            kind = begin if t < 3 else rng.randrange(20)
            rows.append((c if c % 7 else c + 1000, t, ("user", "assistant")[t % 2], texts[(kind + t) % 7]))
    rows += [(2000 + c, t, "user", f"copy {t}") for c in range(30) for t in range(5)]
    rows += [(3001, None, None, "first"), (3001, 5, "user", "last"), (3001, 2, "user", None), (None, 1, "user", "x"), (3003, 0, "user", "one turn")]
    return rows


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(found)] for c, found in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    out = []
    for node, convs in members.items():
        under = [x for x in members if x[:len(node)] == node]
        children = [x for x in under if len(x) == len(node) + 1]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[:-1] == x for y in under)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].split()) for x in under if x)
        out.append((
            convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children), len(leaves),
            saved, hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("cut, shard, depths", [(4_096, 16_384, 4_096), (6, 10, 4), (0, 5, 1)])
def test_trie_equals_brute_force(small_groups, monkeypatch, cut, shard, depths):
    monkeypatch.setattr(prefix_trie, "BLOCK_DEPTHS", depths)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    if cut == 6:
        monkeypatch.setattr(prefix_trie, "BROADCAST_NODES", 0)
    rows = conversations(random.Random(cut))
    df = small_groups.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as depth", "2 as pos", "3 as x", "4 as words")
    got = prefix_trie.prefix_trie(df, cut_rows=cut, shard_rows=shard).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(rows)


def test_trie_of_odd_tables(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert prefix_trie.prefix_trie(only).collect() == []
    # Donor 40 is absent: a conversation that takes over all its turns keeps none.
    lone = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 1, "user", "x"), (lone, 1, "user", "x")]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()
    assert [tuple(r) for r in got] == brute_trie(rows)
    assert got[0]["n_convs"] == 1 and got[0]["depth"] == 0 and len(got) == 1


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 20_000):
        x, y = rng.integers(-2**63, 2**63, (2, n))
        table = prefix_trie.SlotTable(x, y)
        assert sorted(table.slots(x, y)) == list(range(n))
        assert (table.slots(x + 1, y) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.array([1, 1]), np.array([2, 2]))


def test_repair_equals_sql(spark):
    same_as_sql(spark, "op13_structure_repair")


def brute_repair(rows):
    """(cost, audit, lines) of ordered (role, text, fault): the least of every way, by a search over whole audits."""
    initials = {role[:1] for role, _, _ in rows}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, given, lines = heapq.heappop(queue)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", given):
            return cost, audit, lines
        if (audit, at, given) in done or not re.fullmatch("(s?(ua)*u?)?", given):
            continue
        done.add((audit, at, given))
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 2, audit + "I", at, given + role[0], (*lines, f"{role}:")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, given, lines))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                heapq.heappush(queue, (cost + extra, audit + "K", at + 1, given + (role[:1] or "-"), (*lines, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    heapq.heappush(queue, (cost + extra + 2, audit + "R", at + 1, given + other[0], (*lines, f"{other}:{text}")))
    raise AssertionError(initials)


def damage(rows):
    found = defaultdict(list)
    for c, t, role, text in rows:
        conv, turn, role, text = (" " if x is None else str(x) for x in (c, t, role, text))
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        found[c]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            found[c] += [(t is not None, t or 0, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return found


def brute_structure(rows):
    out = []
    for c, own in damage(rows).items():
        own.sort()
        faults, seen = [], set()
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for known, t, _, _ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [x[2][:1] + y[2][:1] for x, y in zip(own, own[1:])]
        cost, audit, lines = brute_repair([(r, x, f) for (_, _, r, x), f in zip(own, faults)])
        out.append((c, gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def broken_conversations(rng, n=60):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "superuser", "agent"]
    texts = ["Yes.", "No", "what?", "", None, " \t", "well! ", "so...\n", "ok \x0b"]
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 4, 5])):
            role = ("user", "assistant")[t % 2] if rng.random() < 0.7 else rng.choice(roles)
            text = f"Turn {t}." if rng.random() < 0.6 else rng.choice(texts)
            rows.append((c, t * rng.choice([1, 1, 2]) if rng.random() < 0.9 else None, role, text))
    distinct = {}
    for row in rows:  # ties of turns are ordered by hashes, so brute force has none
        distinct.setdefault(row[:2], row)
    dropped = next(t for t in range(99) if not zlib.crc32(f"5000:{t}".encode()) % 20)
    return [*distinct.values(), (5000, dropped, "user", "gone"), (None, 1, "user", "Hi."), (None, None, "assistant", "Ho.")]


@pytest.mark.parametrize("piece", [256, 2])
def test_repair_equals_brute_force(small_groups, monkeypatch, piece):
    monkeypatch.setattr(structure_repair, "PIECE_ROWS", piece)
    if piece == 2:
        monkeypatch.setattr(structure_repair, "BROADCAST_CHARS", 0)
    rows = broken_conversations(random.Random(piece))
    df = small_groups.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as pos", "2 as copy", "'z' as conv", "3 as piece")
    got = structure_repair.damage_and_repair(df).collect()
    assert sorted(map(tuple, got), key=repr) == brute_structure(rows)


def test_repair_of_long_and_repeated_rows(spark):
    """A conversation of many pieces, and rows that are there twice: they follow each other."""
    rows = [(7, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(1500)]
    rows += [(8, 1, "user", "Twice.")] * 2 + [(8, 2, "assistant", "Once.")]
    got = {r["conv_id"]: r for r in structure_repair.damage_and_repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    kinds = [zlib.crc32(f"7:{t}".encode()) % 20 for t in range(1500)]
    assert got[7]["blank"] == kinds.count(1) and got[7]["duplicate"] == kinds.count(3)
    assert got[7]["truncated"] == kinds.count(2)
    assert got[7]["gaps"] == sum(k == 0 for k in kinds[1:-1])
    assert got[7]["audit"].count("D") >= kinds.count(1) + kinds.count(3)
    assert len(re.sub("I", "", got[7]["audit"])) == 1500 - kinds.count(0) + kinds.count(3)
    assert [tuple(got[8])] == brute_structure(rows[1500:])
    assert structure_repair.damage_and_repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_suffixes_are_shared():
    """Signatures with equal ends add only nodes for what stands before the common end."""
    automaton = structure_repair.SuffixPath()
    for signature in sorted(["uaua", "suaua", "aaua", "uau"], key=lambda s: s[::-1]):
        path = automaton.follow(signature)
        assert len(path) == len(signature) + 1
    assert automaton.nodes == len({s[i:] for s in ("uaua", "suaua", "aaua", "uau") for i in range(len(s))})
