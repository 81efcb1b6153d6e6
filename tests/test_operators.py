"""Vectors, the lexical index, bucketed snapshots, digests and the table function, against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from codelode.functions import udtf
from codelode.operators import copartitioned, digests, lexical, reconcile, vectors
from codelode.ship import ship


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Vectors ------------------------------------------------------------------------


def groups(n, size, k, spread, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((k, size))[rng.integers(0, k, n)] + spread * rng.standard_normal((n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x):
    return ship(spark).createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")


def best(x, q, k, digits=None):
    score = [0.0] * len(x)
    for i, row in enumerate(x):
        for a, b in zip(row.tolist(), q.tolist(), strict=True):
            score[i] += a * b
    score = vectors.similarity(np.array(score), digits)
    return [(int(i), float(score[i])) for i in np.lexsort((np.arange(len(x)), -score))[:k]]


@pytest.mark.parametrize("digits", [None, 2])
def test_batched_queries(spark, monkeypatch, digits):
    """Blocks of queries and tiles of rows; copies tie by id, also where rounding makes the ties; negative products count as 0."""
    monkeypatch.setattr(vectors, "QUERY_BYTES", 6 * 8 * 8)
    monkeypatch.setattr(vectors, "TILE", 16)
    x = groups(200, 6, 4, 0.5)
    x[50:90] = x[7]
    rows = table(spark, x).repartition(5)
    queries = rows.filter("vec_id < 40").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    got = vectors.batched_topk(rows, queries, 7, id="vec_id", vector="embedding", by="q", query="v", digits=digits)
    assert "CartesianProduct" not in plan(got) and "BroadcastNestedLoopJoin" not in plan(got)
    found = {}
    for r in got.collect():
        found.setdefault(r["q"], []).append((r["rank"], r["vec_id"], r["dense_similarity"]))
    assert {q: [h[1:] for h in sorted(v)] for q, v in found.items()} == {q: best(x, x[q], 7, digits) for q in range(40)}


def test_batched_queries_without_any(spark):
    rows = table(spark, groups(5, 3, 1, 0.1))
    none = rows.filter("vec_id < 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    args = {"id": "vec_id", "vector": "embedding", "by": "q", "query": "v"}
    assert vectors.batched_topk(rows, none, 3, **args).collect() == []
    asked = rows.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    assert vectors.batched_topk(rows, asked, 0, **args).collect() == [] and vectors.batched_topk(rows.filter("vec_id < 0"), asked, 3, **args).collect() == []
    assert vectors.batched_topk(rows, asked, 9, **args).count() == 25
    with pytest.raises(ValueError):
        vectors.batched_topk(rows, asked, -1, **args)


def test_layout_is_exact_and_pruned(spark, tmp_path):
    """Groups apart: other partitions are not read; the result is that of all rows for any query."""
    x = groups(1500, 12, 15, 0.05)
    path = str(tmp_path / "lists")
    known = vectors.write_lists(table(spark, x), path, id="vec_id", vector="embedding", lists=30)
    assert known.rows.sum() == 1500 and len(known.rows) == 30
    for q in (x[3], x[700], -x[3], np.zeros(12), x[3] * 1e6):
        got = [(r["vec_id"], r["dense_similarity"]) for r in vectors.topk(spark, path, q.tolist(), 10, id="vec_id", vector="embedding").collect()]
        assert got == best(x, q, 10)
    few = vectors.pruned(spark, path, x[3].tolist(), 10, best(x, x[3], 10)[-1][1])
    assert 1 <= len(few) <= 5
    found = vectors.topk(spark, path, x[3].tolist(), 10, id="vec_id", vector="embedding", probes=1)
    assert re.search(r"PartitionFilters: \[[^\]]*list", plan(found))
    wide = vectors.topk(spark, path, x[3].tolist(), 2000, id="vec_id", vector="embedding")
    assert [(r["vec_id"], r["dense_similarity"]) for r in wide.collect()] == best(x, x[3], 2000)


def test_distances_are_filters(spark, tmp_path):
    """Within a list, rows too near to the centroid to count are left out by the scan."""
    x = np.vstack([groups(600, 8, 1, 0.4, 3), 3 * groups(60, 8, 1, 0.1, 4)])
    path = str(tmp_path / "lists")
    vectors.write_lists(table(spark, x), path, id="vec_id", vector="embedding", lists=4)
    rows = vectors._scored(spark, path, vectors.read_lists(spark, path), [0, 1, 2, 3], x[-1], 5, least={k: 0.5 for k in range(4)}, id="vec_id", vector="embedding")
    assert "PushedFilters" in plan(rows) and "GreaterThanOrEqual(distance,0.5)" in plan(rows)
    assert [(r["vec_id"], r["dense_similarity"]) for r in vectors.topk(spark, path, x[-1].tolist(), 5, id="vec_id", vector="embedding").collect()] == best(x, x[-1], 5)


def test_probes_recall(spark, tmp_path):
    """Without bounds: the share of the true neighbours grows with the lists that are read, past 0.9."""
    x = groups(2000, 16, 20, 0.25, 5)
    path = str(tmp_path / "lists")
    vectors.write_lists(table(spark, x), path, id="vec_id", vector="embedding", lists=40)

    def recall(probes):
        hit = 0
        for q in range(0, 2000, 200):
            got = vectors.topk(spark, path, x[q].tolist(), 10, id="vec_id", vector="embedding", probes=probes).collect()
            hit += len({r["vec_id"] for r in got} & {i for i, _ in best(x, x[q], 10)})
        return hit / 100

    assert recall(6) >= 0.9


def test_layout_edges(spark, tmp_path):
    empty = table(spark, []).limit(0)
    vectors.write_lists(empty, str(tmp_path / "none"), id="vec_id", vector="embedding")
    assert vectors.topk(spark, str(tmp_path / "none"), [1.0], 3, id="vec_id", vector="embedding").collect() == []
    odd = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="vectors of one length are needed"):
        vectors.write_lists(odd, str(tmp_path / "odd"), id="vec_id", vector="embedding")


# The lexical index ----------------------------------------------------------------


def test_lexical_index_against_contains(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    letters = "abcdé😀_ "
    texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 2, 3, 8, 40]))) for _ in range(300)] + [None, "ab", "xab", "the theory of the thing" * 50]
    tokens = {"".join(rng.choices(letters.strip(), k=rng.choice([2, 3, 4, 7]))) for _ in range(120)} | {"theory", "thing", "zzz", "zz", "ab"}
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, code string").repartition(3)
    asked = spark.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    want = {(t, k) for t in tokens for k, text in enumerate(texts) if text and t in text}
    path = str(tmp_path / "index")
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 7)
    lexical.write(rows, path, id="id", text="code")
    for named, sent in ((500, 200_000), (0, 0)):
        monkeypatch.setattr(lexical, "NAMED", named)
        monkeypatch.setattr(lexical, "SENT", sent)
        got = [tuple(r) for r in lexical.containing(spark, path, asked, id="id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        counts = {r["token"]: (r["n"], r["first"]) for r in lexical.counts(spark, path, asked, id="id").collect()}
        assert counts == {t: (len(k := [i for u, i in want if u == t]), min(k)) for t in {t for t, _ in want}}
    monkeypatch.setattr(lexical, "NAMED", 500)
    monkeypatch.setattr(lexical, "SENT", 200_000)
    one = spark.createDataFrame([("theory",)], "token string")
    blocks = lexical.candidates(spark, path, one)
    assert re.search(r"PushedFilters: \[[^\]]*In\(gram", plan(blocks)) and blocks.count() == 1  # only the piece's row groups are read, and one block of 44 is left
    found = lexical.containing(spark, path, one, id="id")
    assert re.search(r"PushedFilters: \[[^\]]*(In|EqualTo)\(block", plan(found)) and found.count() == 1
    lexical.write(rows.limit(0), str(tmp_path / "none"), id="id", text="code")
    assert lexical.containing(spark, str(tmp_path / "none"), asked, id="id").collect() == []


# Reconciling ------------------------------------------------------------------------


def test_bucketed_snapshots_move_nothing(spark, tmp_path):
    old = spark.createDataFrame([(f"k{k}", f"f{k % 7}", f"text {k}") for k in range(100)], "id string, file_path string, text string")
    new = old.filter("id <> 'k7'").withColumn("text", F.when(F.col("id") == "k9", "other").otherwise(F.col("text"))).unionByName(spark.createDataFrame([("n1", "f1", "new")], old.schema))
    for name, rows in (("reconcile_old", old), ("reconcile_new", new)):
        copartitioned.save(rows, name, str(tmp_path / name), buckets=4)
    found = copartitioned.diff(spark, "reconcile_old", "reconcile_new", compared=("text",))
    assert "Exchange" not in plan(found) and "SortMergeJoin" in plan(found)
    assert sorted(found.collect()) == sorted(reconcile.diff(old, new, compared=("text",)).collect())
    assert {r["change"]: r["count"] for r in found.groupBy("change").count().collect()} == {"unchanged": 98, "updated": 1, "deleted": 1, "inserted": 1}
    for name in ("reconcile_old", "reconcile_new"):
        spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("sent", [10_000, 0])
def test_changes_by_digests(spark, monkeypatch, sent):
    monkeypatch.setattr(digests, "SENT", sent)
    rng = random.Random(1)
    old = {f"{'/'.join(rng.choices('abc', k=rng.randint(0, 4)))}/f{k}".lstrip("/"): f"h{k}" for k in range(400)}
    new = {p: h for p, h in old.items() if rng.random() > 0.02} | {f"a/b/new{k}": "x" for k in range(3)}
    for p in rng.sample(sorted(new), 5):
        new[p] = "edited"
    frame = lambda d: spark.createDataFrame(list(d.items()), "rel string, sha1 string")
    got = {tuple(r) for r in digests.changes(frame(old), frame(new), "rel", ["sha1"]).collect()}
    want = {(p, "added" if p not in old else "deleted" if p not in new else "changed") for p in old.keys() | new.keys() if old.get(p) != new.get(p)}
    assert got == want
    assert digests.changes(frame(old), frame(old), "rel", ["sha1"]).collect() == []
    assert digests.changes(spark.createDataFrame([], "rel string, sha1 string"), frame({"a": "b"}), "rel", ["sha1"]).collect() == [("a", "added")]


def test_digests_count_repeated_rows(spark):
    """Rows that cancel out in an exclusive or do not in the sums."""
    frame = lambda n: spark.createDataFrame([("p", "h")] * n, "rel string, sha1 string").withColumn("g", F.lit(1))
    assert digests.differing(frame(1), frame(3), ["g"], ["rel", "sha1"]).collect() == [(1, 1, 3)]
    assert digests.differing(frame(2), frame(2), ["g"], ["rel", "sha1"]).collect() == []


# The table function --------------------------------------------------------------------


def test_carve_in_sql(spark):
    udtf.register(spark)
    text = "# Head #\n\n```\n# not\n```\n## Sub\nx = foo(1)"
    files = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "<a><Br/>\n<b c='d'>")], "id long, text string")
    ask = lambda what: [tuple(r) for r in spark.sql(f"SELECT f.id, c.* FROM {{f}} AS f, LATERAL carve(f.text, '{what}') AS c ORDER BY 1, 2, 3", f=files).collect()]
    assert [r for r in ask("headings")] == [(1, 1, 1, "Head"), (1, 6, 2, "Sub")]
    assert (1, "Head", "class", 1) in ask("lines") and (1, "foo", "section", 7) in ask("lines") and len(ask("lines")) == 8
    assert (1, 7, 6) in ask("tokens")
    assert ask("tags") == [(4, "a", 1, 0), (4, "b", 2, 0), (4, "br", 1, 1)]
    for wrong in ("carve(f.text, 'other')", "carve(f.id, 'lines')"):
        with pytest.raises(AnalysisException, match="carve"):
            spark.sql(f"SELECT * FROM {{f}} AS f, LATERAL {wrong}", f=files)
