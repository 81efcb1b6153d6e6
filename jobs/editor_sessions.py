"""Turns a folder of events into editor sessions, each of which asks for the index to be refreshed, as a stream.

    python jobs/editor_sessions.py --events PATH --output PATH --checkpoint PATH [--config FILE]

A run takes the event files that its checkpoint does not know yet, works through them and ends.
``output`` has a row for each session that is over, by the day it began (UTC): user, first and
last event in microseconds since 1970, and how many.  A session is over once its last event and the
gap lie before the watermark, which is the latest event seen less the delay; until then the
checkpoint keeps it.  Events older than the watermark are late and dropped.  Spark's file sink
notes which files count, so a run that was cut short is made up by the next.

Sessions are merged within each task before they are shuffled, so that a user with many events
sends a few rows.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.sources import parts
from codelode.streaming.sessions import sessions
from jobs import common

log = logging.getLogger("jobs.editor_sessions")

SESSIONS = "user_id long, started_us long, last_seen_us long, events long, day string"


def finished(spark: SparkSession, output: str) -> DataFrame:
    """The sessions that are over, as they stand."""
    return spark.read.schema(SESSIONS).parquet(output) if parts.exists(spark, output) else spark.createDataFrame([], SESSIONS)


def _pattern(path: str) -> str:
    """The path as a pattern that it alone matches: Spark's file streams take a single file by a pattern only."""
    path = path.rstrip("/")
    return path if set("*?[{") & set(path) else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, events: str, output: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Works through the event files that are new; how many events were read, were late, and sessions written."""
    config = config or common.config("editor_sessions")
    schema = spark.read.parquet(events).schema
    with common.settings(spark, spark__sql__session__timeZone="UTC", spark__sql__shuffle__partitions=str(config["state_partitions"]), spark__sql__streaming__sessionWindow__merge__sessions__in__local__partition="true"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(_pattern(events))
        over = sessions(stream, config["gap"], config["delay"])
        rows = over.select(F.col("user_id").cast("long").alias("user_id"), F.unix_micros("started").alias("started_us"), F.unix_micros("last_seen").alias("last_seen_us"), "events", F.date_format("started", "yyyy-MM-dd").alias("day"))
        query = rows.writeStream.format("parquet").outputMode("append").option("path", output).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()
        query.awaitTermination()
    progress = query.recentProgress
    told = {"batches": len(progress), "events_read": sum(p["numInputRows"] for p in progress), "late": sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]), "sessions_written": sum(max(0, p["sink"].get("numOutputRows") or 0) for p in progress)}
    log.info("%(events_read)d events read from %(events)s in %(batches)d batches, %(late)d late; %(output)s has what is over", told | {"events": events, "output": output})
    return told


if __name__ == "__main__":
    common.main("editor_sessions", __doc__, {"events": "a folder of Parquet files with user_id and ts", "output": "the sessions' folder", "checkpoint": "the stream's checkpoint"}, run)
