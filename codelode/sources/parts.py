"""Tables of which parts are replaced: Parquet partitioned by a column, overwritten part by part.

Spark's dynamic overwrite leaves partitions alone that get no row.  So that a part can become empty, it gets
one row of nulls then, which ``read`` leaves out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The table as it stands, empty if nothing is there yet; key: a column that no row of it has as null."""
    found = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return found.filter(F.col(key).isNotNull())


def replace(rows: DataFrame, path: str, schema: str, by: str, order: str, emptied: list[int] = (), row_group: int = 128 << 20) -> int:
    """Overwrites the parts that rows or ``emptied`` name, one file each, and no other; the number of rows.

    rows may be read from the same table: new files are complete before old ones go.
    """
    spark, seen = rows.sparkSession, Observation()
    names = [f.split()[0] for f in schema.split(", ")]
    gone = spark.createDataFrame([(b,) for b in emptied], f"{by} int")
    whole = rows.observe(seen, F.count(F.lit(1)).alias("rows")).select(*names).unionByName(gone, allowMissingColumns=True)
    dealt = whole.repartition(by).sortWithinPartitions(by, order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", str(row_group)).partitionBy(by).parquet(path)
    return seen.get["rows"]
