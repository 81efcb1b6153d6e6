"""Editor sessions in event time: events of a user with no more than a gap between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

GAP, DELAY = "30 minutes", "1 hour"


def sessions(events: DataFrame, gap: str = GAP, delay: str | None = None) -> DataFrame:
    """(user_id, started, last_seen, events) of each session; events: user_id and ts.

    On a stream ``delay`` sets the watermark: a session is emitted once its last event and the gap lie
    before the latest event less the delay, and events older than the watermark are late and change
    nothing any more.  Events without a time take no part; a null user is a user.
    """
    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).filter("ts is not null")
    timed = timed.withWatermark("ts", delay) if delay else timed
    # The state of sessions leaves null keys out; a struct is not null.
    grouped = timed.groupBy(F.struct("user_id").alias("user"), F.session_window("ts", gap).alias("window"))
    return grouped.agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count("*").alias("events")).select("user.user_id", "started", "last_seen", "events")
