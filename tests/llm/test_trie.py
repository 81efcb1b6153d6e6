"""The conversation trie against a recursive version and DuckDB."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict

import duckdb
import pytest

from codelode.llm import _join, trie
from codelode.llm._store import prepare

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The trie as dictionaries, walked from the root."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append(((turn is not None, turn or 0), role, text[:40].encode(), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(t[1], t[4]) for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    found = []

    def walk(path):
        leaves, saved = int(not children[path]), (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        for below in children[path]:
            n, s = walk(below)
            leaves, saved = leaves + n, saved + s
        ends = ",".join(str(c) for c in sorted(members[path]) if len(built[c]) == len(path))
        found.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(children[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        sys.setrecursionlimit(10_000)
        walk(())
    return sorted(found, key=str)


def conversations(seed):
    """Missing bases, negative ids, ties, nulls, repeated rows, copies of one conversation, and a long one."""
    rng, rows = random.Random(seed), []
    for c in range(-7, 60):
        for t in range(rng.choice([0, 0, 1, 2, 5, 12])):
            rows.append((c, rng.choice([t, t, None, 0]), rng.choice(["user", "a", None]), rng.choice(["x", "yé", None, "", "x" * 5000, "x" * 41 + "y"])))
    rows += [*rows[:5], (None, 1, "user", "z")]
    rows += [(c, t, "u", "same") for c in range(100, 140) for t in range(10)]
    return rows + [(1000, t, "u", f"long {t % 3}") for t in range(300)]


@pytest.fixture
def frame(spark):
    prepare(spark)
    extra = ("base", "k1", "depth", "n", "rows", "owner", "digest", "ends")
    return lambda rows: spark.createDataFrame([(*r, *extra) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in extra))


@pytest.mark.parametrize(("sent", "long"), [(10_000, 100_000), (0, 100_000), (10_000, 9), (0, 40)])
def test_against_recursion(frame, monkeypatch, sent, long):
    """Also where merged nodes are shuffled and hot ones sent alone, where shared ends come in many pieces, and where conversations are sliced."""
    monkeypatch.setattr(trie, "LONG", long)
    monkeypatch.setattr(_join, "SENT_ROWS", sent)
    monkeypatch.setattr(_join, "HOT_ROWS", 3)
    monkeypatch.setattr(_join, "HOT_KEYS", 10)
    monkeypatch.setattr(trie, "CHUNK", 3)
    monkeypatch.setattr(trie, "CHUNK_ROWS", 20)
    rows = conversations(sent + long)
    assert (trie.long_ones(frame(rows))[0] is None) == (long > 1_000)
    got = trie.nodes(frame(rows))
    assert got.columns == COLUMNS and {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_against_sql(frame):
    rows = [r for r in conversations(7) if r[0] != 1000]
    con = duckdb.connect()
    con.execute("CREATE TABLE turns (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO turns VALUES (?, ?, ?, ?)", rows)
    want = con.execute(trie.SQL.format(turns="turns"))
    assert [c[0] for c in want.description] == COLUMNS
    assert sorted(want.fetchall(), key=str) == brute(rows)


def test_one_copied_conversation_and_none(frame):
    """Copies make one chain; turnless conversations end in the root; no turns, no nodes."""
    rows = [(5 * c, t, "u", "é" * 4) for c in range(50) for t in range(20)]
    rows.append((10_001, 0, "u", "own"))  # its base is absent
    got = sorted(map(tuple, trie.nodes(frame(rows)).collect()), key=str)
    assert got == brute(rows)
    assert trie.nodes(frame([])).collect() == [] and trie.nodes(frame([(None, 1, "u", "t")])).collect() == []
