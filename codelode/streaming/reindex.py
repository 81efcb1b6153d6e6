"""Re-indexing as a stream: a file source that names changed files, reconciled batch by batch.

Reconciling is keyed and idempotent, so a batch that runs twice does no harm and no state store is needed.
Paths may be remote: all is read and written by Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from codelode import schema
from codelode.functions import text as X
from codelode.operators.reconcile import last_wins
from codelode.sources import parts


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON lines (rel, text, seq) that a watcher drops into a folder; text null: the file is gone."""
    return spark.readStream.schema("rel string, text string, seq long").json(folder)


#: Parts of the table by hash of the path, unless told otherwise; a batch rewrites those that its files fall into.
PARTS = 64
_SCHEMA = "id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.SYMBOL) + ", part int"


def read(spark: SparkSession, target: str) -> DataFrame:
    """The table of symbols as the last batch left it."""
    return parts.read(spark, target, _SCHEMA, "file_path").drop("part")


def upsert_into(target: str, extract: Callable[[DataFrame], DataFrame], n_parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A batch function: files of the batch replace their rows in a table of symbols (of equal files the last counts).

    Only the parts that hold the batch's files are read and written anew, in one dynamic overwrite.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64("file_path"), F.lit(n_parts)).cast("int")
        latest = last_wins(batch.filter("rel is not null"), key="rel", order="seq").withColumnRenamed("rel", "file_path").withColumn("part", part)
        touched = [r[0] for r in latest.select("part").distinct().collect()]  # n_parts at most
        if not touched:
            return
        new = extract(latest.filter("text is not null").select("file_path", "text")).withColumn("part", part)
        stored = parts.read(spark, target, _SCHEMA, "file_path").filter(F.col("part").isin(touched))
        kept = stored.join(latest.select("file_path"), "file_path", "left_anti")
        parts.replace(new.select(*kept.columns).unionByName(kept), target, _SCHEMA, "part", "file_path", emptied=touched)

    return run


def start(spark: SparkSession, folder: str, target: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], n_parts: int = PARTS) -> StreamingQuery:
    """Works off all files that wait and stops."""
    return changed_files(spark, folder).writeStream.foreachBatch(upsert_into(target, extract, n_parts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def extract_with_ids(carve: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(files: DataFrame) -> DataFrame:
        rows = carve(files)
        return last_wins(rows.select(X.doc_id().alias("id"), *schema.SYMBOL_COLUMNS, "seq")).drop("seq").select(*schema.SYMBOL_COLUMNS, "id")

    return run
