"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the threads (default 8).
Each query runs once to warm up and then twice; the faster run counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from codelode.plans import catalog  # noqa: E402

HEADLINE = ("sym_view", "hybrid_query", "hybrid_query_filtered", "dense_topk", "dense_topk_batched", "lexical_score", "token_estimate_docs", "token_savings", "embed_hash_buckets", "reconcile_diff", "stale_flags", "dedup_last_wins", "suffix_lang_coverage", "html_sections", "file_hash")


def timed(run) -> float:
    began = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run = lambda name=name: catalog.QUERIES[name](spark, sf_dir)
        timed(run)
        times[name] = round(min(timed(run), timed(run)), 3)
    sf = float(m[1]) if (m := re.search(r"sf([\d.]+)/?$", sf_dir)) else None
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
