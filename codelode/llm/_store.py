"""Cutting lineage in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from codelode.ship import ship

#: Rows and bytes of an Arrow batch, unless the session says otherwise: whole texts make batches of Spark's defaults too large.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
#: Bytes of a row group of settled tables, which a task holds while it writes; their codec, which works on the heap (Snappy's direct buffers pile up until a collection).
ROW_GROUP, CODEC = 16 << 20, "zstd"
_ROWS, _SPARK_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
_BYTES, _SPARK_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def prepare(spark: SparkSession) -> SparkSession:
    """Gives the executors the package, and texts smaller batches."""
    if spark.conf.get(_ROWS) == _SPARK_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    if spark.conf.get(_BYTES) == _SPARK_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    return ship(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder; one of this machine only on a local master without one, as in tests."""
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="codelode-checkpoints-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back; the table goes when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/codelode-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.option("parquet.block.size", str(ROW_GROUP)).option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder, so that a lost executor costs no more than a read."""
    return written(df, "step")
