"""The jobs as queries over the driver's tables: each runs twice into one new folder, and its whole output is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelode.plans.corpus_view import SYM
from codelode.sources.shared import own_folder
from jobs import common, editor_sessions, snippet_catalogue


def job1_snippet_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of all documents; the second run finds nothing new."""
    output = own_folder(spark, "snippet-catalogue")
    for _ in range(2):
        snippet_catalogue.run(spark, f"{sf_dir}/documents.parquet", output)
    return snippet_catalogue.snippets(spark, output)


def job2_editor_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of all events that are over; the second run finds no new file."""
    folder = own_folder(spark, "editor-sessions")
    for _ in range(2):
        editor_sessions.run(spark, f"{sf_dir}/events.parquet", f"{folder}/sessions", f"{folder}/checkpoint")
    return editor_sessions.finished(spark, f"{folder}/sessions")


QUERIES = {f.__name__: f for f in (job1_snippet_catalogue, job2_editor_sessions)}
ORACLE_SQL = {
    "job1_snippet_catalogue": rf"""
WITH {SYM}
SELECT id, file_path, symbol_name, kind, language, start_line, end_line, code_content, len(regexp_extract_all(code_content, '[A-Za-z_][A-Za-z0-9_]*|\d+|[^\sA-Za-z0-9_]')) AS tokens,
  ('0x' || right(md5(file_path), 4))::INT % {common.config("snippet_catalogue")["buckets"]} AS bucket FROM sym""".strip(),
    "job2_editor_sessions": """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS last_seen_us, count(*) AS events, strftime(min(ts), '%Y-%m-%d') AS day
FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR""".strip(),
}
