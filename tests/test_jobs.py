"""The two jobs: runs over growing input, runs that were cut short, command lines, and the queries' SQL."""

import datetime as dt
import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from codelode.operators.reconcile import last_wins
from codelode.plans.corpus_view import extracted
from codelode.sources import parts as parts_module
from jobs import common, editor_sessions, queries, snippet_catalogue

ROOT, DATA = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"
SMALL = {"buckets": 4, "row_group_bytes": 1 << 20}


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def catalogue(spark, output):
    return sorted(tuple(r) for r in snippet_catalogue.snippets(spark, output).drop("bucket", "tokens").collect())


def afresh(spark, path):
    return sorted(tuple(r) for r in last_wins(extracted(spark.read.parquet(path).filter("lang is not null"))).drop("seq").select(*[f.split()[0] for f in snippet_catalogue.SNIPPETS.split(", ")[:8]]).collect())


def parts(output):
    return {p.relative_to(output).as_posix() for p in Path(output).rglob("part-*.parquet")}


def test_catalogue_follows_growing_input(spark, tmp_path):
    """New, edited and deleted documents; what is carved; buckets without a change keep their files; a second run writes nothing."""
    rows = [(k, f"first {k}\nsame name\nsame name\nlast {k}", "en", "src") for k in range(40)] + [(90, None, "en", "src"), (91, "text", None, "src"), (92, "", "en", "src"), (3, "another row of one path", "en", "src")]
    path, output = documents(spark, str(tmp_path / "docs"), rows), str(tmp_path / "out")
    told = snippet_catalogue.run(spark, path, output, SMALL)
    assert told["files_read"] == len(rows) - 1 and told["buckets_changed"] == 4  # a document without a language has no path
    assert catalogue(spark, output) == afresh(spark, path)
    before = parts(output)
    assert snippet_catalogue.run(spark, path, output, SMALL) == {"buckets_before": 4, "buckets_changed": 0, "files_read": 0, "files_written": 0, "snippets_written": 0}
    assert parts(output) == before
    grown = [r for r in rows if r[0] != 7] + [(100, "brand new\nlines", "de", "src")]
    grown[5] = (5, "edited words\nand more", "en", "src")
    documents(spark, path, grown)
    told = snippet_catalogue.run(spark, path, output, SMALL)
    assert told["files_read"] == 2 and 1 <= told["buckets_changed"] <= 3
    assert catalogue(spark, output) == afresh(spark, path)
    after = parts(output)
    kept = {p.split("/")[1] for p in before & after}
    assert len({p.split("/")[1] for p in before}) - len(kept) == told["buckets_changed"]
    fresh = str(tmp_path / "fresh")
    snippet_catalogue.run(spark, path, fresh, SMALL)
    assert catalogue(spark, fresh) == catalogue(spark, output)


def test_catalogue_is_made_up_after_a_cut(spark, tmp_path, monkeypatch):
    """Snippets without their mark: the next run does the same buckets once more."""
    path, output = documents(spark, str(tmp_path / "docs"), [(k, f"name{k} x\ny", "en", "s") for k in range(9)]), str(tmp_path / "out")
    snippet_catalogue.run(spark, path, output, SMALL)
    documents(spark, path, [(k, f"other{k} x\ny", "en", "s") for k in range(3, 12)])
    write = parts_module.replace

    def cut(rows, to, *rest):
        if to.endswith("/files"):
            raise RuntimeError("lost")
        return write(rows, to, *rest)

    monkeypatch.setattr(parts_module, "replace", cut)
    with pytest.raises(RuntimeError):
        snippet_catalogue.run(spark, path, output, SMALL)
    monkeypatch.undo()
    snippet_catalogue.run(spark, path, output, SMALL)
    assert catalogue(spark, output) == afresh(spark, path)


def test_catalogue_of_nothing(spark, tmp_path):
    """All documents gone: emptied buckets are known as empty, and stay so."""
    path, output = documents(spark, str(tmp_path / "docs"), [(k, "a b", "en", "s") for k in range(9)]), str(tmp_path / "out")
    snippet_catalogue.run(spark, path, output, SMALL)
    documents(spark, path, [])
    assert snippet_catalogue.run(spark, path, output, SMALL)["snippets_written"] == 0
    assert catalogue(spark, output) == [] and snippet_catalogue.run(spark, path, output, SMALL)["buckets_changed"] == 0


def events(spark, folder, name, rows):
    at = dt.datetime(2024, 5, 1)
    df = spark.createDataFrame([(u, None if m is None else at + dt.timedelta(minutes=m)) for u, m in rows], "user_id long, ts timestamp").selectExpr("user_id", "cast(ts as timestamp_ntz) as ts")
    df.coalesce(1).write.parquet(f"{folder}/{name}")
    for p in Path(folder, name).glob("*.parquet"):
        p.rename(Path(folder, f"{name}.parquet"))


def over(spark, output):
    at = 1714521600000000  # 2024-05-01
    return sorted(((r["user_id"], (r["started_us"] - at) // 60_000_000, (r["last_seen_us"] - at) // 60_000_000, r["events"], r["day"]) for r in editor_sessions.finished(spark, output).collect()), key=str)


def test_sessions_of_growing_input(spark, tmp_path):
    """A session goes on over two runs, is emitted once, late events change nothing, and settings are as before."""
    folder, output, checkpoint = (str(tmp_path / x) for x in ("events", "out", "checkpoint"))
    Path(folder).mkdir()
    zone = spark.conf.get("spark.sql.session.timeZone")
    events(spark, folder, "a", [(1, 0), (1, 29), (1, 60), (2, 10), (1, 100), (2, 150), (None, 5), (None, 8), (3, None)])
    told = editor_sessions.run(spark, folder, output, checkpoint)
    assert told["events_read"] == 9 and told["late"] == 0
    first = [(1, 0, 29, 2, "2024-05-01"), (1, 60, 60, 1, "2024-05-01"), (2, 10, 10, 1, "2024-05-01"), (None, 5, 8, 2, "2024-05-01")]
    assert over(spark, output) == sorted(first, key=str)  # the watermark is 90; 60 and its gap reach it
    assert editor_sessions.run(spark, folder, output, checkpoint)["events_read"] == 0 and over(spark, output) == sorted(first, key=str)
    events(spark, folder, "b", [(2, 179), (1, 20), (4, 1500), (1, 125)])  # 20 is late; 100 and 125, and 150 and 179, are sessions
    told = editor_sessions.run(spark, folder, output, checkpoint)
    assert told["events_read"] == 4 and told["late"] == 1
    assert over(spark, output) == sorted([*first, (1, 100, 125, 2, "2024-05-01"), (2, 150, 179, 2, "2024-05-01")], key=str)
    assert spark.conf.get("spark.sql.session.timeZone") == zone


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLE_SQL[name])
    at = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(at)
    rows = sorted(map(tuple, got.select(*at).collect()), key=str)
    assert rows and rows == sorted(want.fetchall(), key=str)


def test_settings_are_checked(tmp_path):
    own = tmp_path / "own.json"
    own.write_text(json.dumps({"buckets": 2}))
    assert common.config("snippet_catalogue", str(own))["buckets"] == 2
    own.write_text(json.dumps({"bucket": 2}))
    with pytest.raises(ValueError, match="unknown settings: bucket"):
        common.config("snippet_catalogue", str(own))


def test_command_line(tmp_path):
    """The job as it is run: paths and a config file, its own session, a log of what it read and wrote."""
    own = tmp_path / "own.json"
    own.write_text(json.dumps({"buckets": 2}))
    command = [sys.executable, str(ROOT / "jobs/snippet_catalogue.py"), "--documents", f"{DATA}/documents.parquet", "--output", str(tmp_path / "out"), "--config", str(own)]
    done = subprocess.run(command, capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "200 documents carved" in done.stderr and {p.name for p in (tmp_path / "out/snippets").glob("bucket=*")} == {"bucket=0", "bucket=1"}
