"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import _join, neighbours
from codelode.llm._store import prepare


@pytest.fixture
def frame(spark):
    prepare(spark)

    def make(rows, kind="float"):
        return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], f"vec_id long, embedding array<{kind}>, sig string, v string, list string")

    return make


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def product(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=False):
        total += x * y  # sum() would compensate
    return total


def brute(rows, top=20, every=20):
    """All answers by id, for rows with different ids or equal vectors."""
    own = {(i, tuple(float(x) for x in v)) for i, v in rows if i is not None and usable(v)}
    found = {}
    for q, a in own:
        if q % every == 0:
            best = sorted((-product(a, b), i) for i, b in own if i != q)[:top]
            found[q] = [(i, -s) for s, i in best]
    return found


def answers(frame):
    found = {}
    for r in frame.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in found.values())
    return {q: [x[1:] for x in sorted(v)] for q, v in found.items()}


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in v}) for q, v in want.items()) / sum(map(len, want.values()))


def clustered(seed, n, size, groups):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, size))
    return (centres[rng.integers(0, groups, n)] + 0.4 * rng.standard_normal((n, size))).astype("f4")


@pytest.mark.parametrize("shape", ["clusters", "uniform", "norms"])
def test_recall_and_exact_scores(frame, monkeypatch, shape):
    """At least 0.9 of the true neighbours, in small tiles and shares; scores are those of the original vectors to the last bit."""
    monkeypatch.setattr(neighbours, "STEP", 64)
    monkeypatch.setattr(neighbours, "TILE_BYTES", 64 * 24 * 4)
    monkeypatch.setattr(neighbours, "TASK_PAIRS", 2_000)
    x = clustered(1, 1500, 24, 12) if shape != "uniform" else np.random.default_rng(2).standard_normal((1500, 24)).astype("f4")
    if shape == "norms":
        x *= np.exp(np.random.default_rng(3).standard_normal((1500, 1)))
    x = x.astype("f4")
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    got, want = answers(neighbours.search(frame(rows), F.col("vec_id") % 20 == 0)), brute(rows)
    assert recall(got, want) >= 0.9 and got.keys() == want.keys()
    vectors = dict(rows)
    for q, hits in got.items():
        assert len(hits) == 20 and all(s == product(vectors[q], vectors[i]) for i, s in hits)
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))


def test_copies_are_ordered_by_id(frame, monkeypatch):
    """A third of the rows are one vector: the nearest of each are the least ids, without its own; hot queries are sent alone."""
    monkeypatch.setattr(_join, "SENT_ROWS", 0)
    monkeypatch.setattr(_join, "HOT_ROWS", 3)
    monkeypatch.setattr(_join, "HOT_KEYS", 3)
    x = clustered(4, 400, 8, 5)
    rows = [(k, [float(v) for v in (x[0] if k % 3 == 0 else x[k])]) for k in range(400)]
    rows += rows[:7]  # repeated rows count once
    got, want = answers(neighbours.search(frame(rows), F.col("vec_id") % 20 == 0)), brute(rows)
    assert recall(got, want) >= 0.9
    same = [k for k in range(400) if k % 3 == 0]
    if abs(product(rows[0][1], rows[0][1])) >= max(abs(product(rows[0][1], v)) for _, v in rows):
        for q in range(0, 400, 60):
            assert [i for i, _ in got[q]] == [k for k in same if k != q][:20]


def test_few_and_odd_vectors(frame):
    """Fewer candidates than asked for, vectors that take no part, other lengths, extreme values, no rows."""
    inf, nan = math.inf, math.nan
    rows = [(0, [1.0, 2.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [1.0, nan]), (100, [inf, 1.0]), (None, [1.0, 1.0]), (120, []), (1, [3.0]), (2, [1.0, 1.0, 5.0]), (3, [-1.0, 0.5]), (-20, [1e-30, 1e30])]
    got = answers(neighbours.search(frame(rows), F.col("vec_id") % 20 == 0))
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert got == want and set(got) == {0, -20} and len(got[0]) == 4
    wide = [(0, [1e200, 1.0]), (1, [1e100, 2.0]), (2, [5.0, 3.0])]
    assert answers(neighbours.search(frame(wide, "double"), F.col("vec_id") % 20 == 0)) == brute(wide)
    assert neighbours.search(frame([]), F.col("vec_id") % 20 == 0).collect() == []
    assert neighbours.search(frame([(0, [1.0])]), F.col("vec_id") % 20 == 0).collect() == []


def test_abandoned_pairs_are_far():
    """Without doubt the test is an estimate; with much of it no pair within the bound is lost."""
    rng = np.random.default_rng(5)
    q, x = rng.standard_normal((20, 40)), rng.standard_normal((300, 40))
    distance = ((q[:, None] - x[None]) ** 2).sum(2)
    bound = np.quantile(distance, 0.05, axis=1)
    a, b = neighbours.survivors(q, x, bound)
    near = {(i, j) for i, j in zip(*np.nonzero(distance <= bound[:, None]), strict=True)}
    assert len(near & set(zip(a.tolist(), b.tolist(), strict=True))) >= 0.95 * len(near)
    assert (distance[a, b] <= bound[a] + 1e-9).all()
