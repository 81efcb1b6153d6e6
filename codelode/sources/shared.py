"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in the one that spark.checkpoint.dir names; on a local master without one, as in tests, in one of this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            shared = known.get()
        elif spark.sparkContext.master.startswith("local"):
            shared = tempfile.mkdtemp(prefix="codelode-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
