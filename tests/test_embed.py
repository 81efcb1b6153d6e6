"""The hash embedder against plain Python, and the plans of the queries that use it."""

import hashlib
import math
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codelode.functions import embed
from codelode.functions.embed import HashEmbedder
from codelode.plans import catalog
from codelode.ship import ship

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "a 1 _ é", "Fetch fetch_all FETCH x1", "Straße ÉA Kelvin", "x" * 5000, " ".join(f"t{k % 700}" for k in range(3000)), "the\nthe\tThe"]
QUESTION = "fetch the t1 t2 t3"


def wanted(text):
    return Counter(hashlib.md5(t.encode()).digest()[-1] % 64 for t in re.findall(r"[A-Za-z_][A-Za-z0-9_]+", (text or "").lower(), re.ASCII))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("remembered", [1 << 17, 3])
def test_counts_vectors_and_similarity(spark, monkeypatch, remembered):
    """For nulls, texts without tokens and with many, also where a worker remembers few of them."""
    rows = ship(spark).createDataFrame(list(enumerate(TEXTS * 400)), "id int, text string").repartition(3)
    e, asked = HashEmbedder(), wanted(QUESTION)
    got = rows.select("text", e.counts(F.col("text")).alias("c"), e.column(F.col("text")).alias("v"), e.similarity(F.col("text"), QUESTION).alias("s")).collect()
    assert len(got) == len(TEXTS) * 400
    for r in got:
        want = wanted(r["text"])
        assert {x["bucket"]: x["n"] for x in r["c"]} == want and len(r["c"]) == len(want)
        norm = math.sqrt(sum(n * n for n in want.values()))
        assert r["v"] == pytest.approx([want[k] / (norm or 1) for k in range(64)], abs=1e-7)
        assert r["s"] == pytest.approx(sum(n * asked[k] for k, n in want.items()) / ((norm or 1) * math.sqrt(sum(n * n for n in asked.values()))), abs=1e-12)
    monkeypatch.setattr(embed, "_REMEMBERED", remembered)
    embed._bucket.clear()
    assert all(embed._bucket[f"t{k}".encode()] == hashlib.md5(f"t{k}".encode()).digest()[-1] % 64 for k in range(9)) and len(embed._bucket) <= remembered


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["hybrid_query", "hybrid_query_filtered", "hybrid_query_weights", "ranked_hits"])
def test_a_task_keeps_its_part_of_the_pool(spark, name):
    """No sort of all symbols, which computes each similarity twice and shuffles every symbol."""
    found = plan(catalog.QUERIES[name](spark, SF))
    assert "TakeOrderedAndProject" in found and "rangepartitioning" not in found


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_buckets_are_counted_where_symbols_are(spark):
    found = plan(catalog.QUERIES["embed_hash_buckets"](spark, SF))
    assert "Aggregate" not in found and found.count("Exchange") == 1  # documents are dealt evenly, nothing else moves
