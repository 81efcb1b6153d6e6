"""Keeps a catalogue of snippets in step with a table of documents, taking only what is new.

    python jobs/snippet_catalogue.py --documents PATH --output PATH [--config FILE]

``output``/snippets has a row for each snippet of each document: key, path, name, kind, language,
lines, code and estimated tokens, partitioned by a bucket of the path.  ``output``/files has each
document's path and SHA-1 likewise, and is the mark of what the catalogue holds.

A run compares digests of buckets with the mark, then paths and hashes in the buckets that differ.
Only new and edited documents are carved; of the other documents of those buckets the snippets are
taken over; buckets without a change are not touched.  Snippets are written before the mark, so a
run that was cut short is made up by the next, and a run without changes writes nothing.

Documents without a path (a null
source, id or language) take no part; of rows with one path all are carved, and of equal keys the
last line wins.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from codelode.functions import text as X
from codelode.operators.digests import bucket_of, differing
from codelode.operators.reconcile import last_wins
from codelode.plans.corpus_view import extracted
from codelode.ship import ship
from codelode.sources import parts
from jobs import common

log = logging.getLogger("jobs.snippet_catalogue")

SNIPPETS = "id string, file_path string, symbol_name string, kind string, language string, start_line int, end_line int, code_content string, tokens int, bucket int"
FILES = "file_path string, sha1 string, bucket int"


def snippets(spark: SparkSession, output: str) -> DataFrame:
    """The catalogue as it stands."""
    return parts.read(spark, f"{output}/snippets", SNIPPETS, "file_path")


def files(spark: SparkSession, output: str) -> DataFrame:
    """The mark: what the catalogue holds."""
    return parts.read(spark, f"{output}/files", FILES, "file_path")


def run(spark: SparkSession, documents: str, output: str, config: dict | None = None) -> dict[str, int]:
    """Brings the catalogue up to date; what was read, carved and written."""
    config = config or common.config("snippet_catalogue")
    docs = ship(spark).read.parquet(documents)
    path = F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    docs = docs.withColumn("file_path", path).filter("file_path is not null")
    now = docs.select("file_path", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("sha1"), bucket_of("file_path", config["buckets"]).alias("bucket"))
    before = files(spark, output)
    told = {"buckets_before": before.select("bucket").distinct().count()}
    changed = differing(before, now, ["bucket"], ["file_path", "sha1"]).collect()  # a row for each bucket at most
    told["buckets_changed"] = len(changed)
    log.info("%s: %d buckets differ from the %d of %s", documents, len(changed), told["buckets_before"], output)
    if not changed:
        return told | {"files_read": 0, "files_written": 0, "snippets_written": 0}
    touched, emptied = [r["bucket"] for r in changed], [r["bucket"] for r in changed if not r["n_new"]]
    now, before = now.filter(F.col("bucket").isin(touched)), before.filter(F.col("bucket").isin(touched))
    state = lambda rows, name: rows.groupBy("file_path").agg(F.sort_array(F.collect_list("sha1")).alias(name))
    both = state(now, "new").join(state(before, "old"), "file_path", "left")  # paths that are gone drop out
    fresh, same = both.filter(~F.col("new").eqNullSafe(F.col("old"))).select("file_path"), both.filter("new = old").select("file_path")
    read = Observation()
    carved = docs.join(fresh, "file_path", "left_semi").observe(read, F.count(F.lit(1)).alias("rows"))
    carved = last_wins(extracted(carved)).drop("seq").withColumn("tokens", X.estimate_tokens("code_content")).withColumn("bucket", bucket_of("file_path", config["buckets"]))
    kept = snippets(spark, output).filter(F.col("bucket").isin(touched)).join(same, "file_path", "left_semi")
    told["snippets_written"] = parts.replace(carved.unionByName(kept), f"{output}/snippets", SNIPPETS, "bucket", "file_path", emptied, config["row_group_bytes"])
    told["files_read"] = read.get["rows"]
    told["files_written"] = parts.replace(now, f"{output}/files", FILES, "bucket", "file_path", emptied, config["row_group_bytes"])
    log.info("%(files_read)d documents carved, %(snippets_written)d snippets and %(files_written)d files written to %(output)s", told | {"output": output})
    return told


if __name__ == "__main__":
    common.main("snippet_catalogue", __doc__, {"documents": "a Parquet table with doc_id, text, lang and source", "output": "the catalogue's folder"}, run)
