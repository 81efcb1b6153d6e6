"""The command line: one JSON value on standard output, all else on standard error."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from codelode import __version__, bootstrap, schema
from codelode.api import Engine, IndexError_, LockedError, UnsafeRootError
from codelode.functions.embed import named_model
from codelode.operators.search import CANDIDATES, DENSE_WEIGHT, LEXICAL_WEIGHT, TOP, FilterError
from codelode.sources.store import Store

#: Texts that a model embeds at a time, unless told otherwise.
BATCH = 128


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("codelode")
    p.add_argument("--version", action="store_true")
    sub = p.add_subparsers(dest="command")
    add = lambda name, *args: _with(sub.add_parser(name), args)
    i = add("index", "path", "--db", "--model", "!--reset", "!-D/--definitions", "!--force")
    i.add_argument("--batch", type=int, default=BATCH)
    q = add("query", "text", "--db", "--model", "--filter", "--kind", "--lang", "--root", "!--tokens")
    q.add_argument("-n", "--top", type=int, default=TOP)
    q.add_argument("--candidates", type=int, default=CANDIDATES)
    q.add_argument("--w-dense", type=float, default=DENSE_WEIGHT)
    q.add_argument("--w-lexical", type=float, default=LEXICAL_WEIGHT)
    add("optimize", "--db", "--root")
    add("status", "--db", "--root")
    add("doctor", "--db", "--root")
    add("init", "path", "--db", "--model", "--harness", "!--skip-index", "!--auto-index", "!--force")
    add("hook", "action")
    add("serve", "--db", "--model")
    return p


def _with(p: argparse.ArgumentParser, args: tuple[str, ...]) -> argparse.ArgumentParser:
    for a in args:
        if a.startswith("!"):
            p.add_argument(*a[1:].split("/"), action="store_true")
        else:
            p.add_argument(a)
    return p


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("codelode").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(a: argparse.Namespace, engine: Engine) -> tuple[dict, int]:
    """The payload and the exit code of a command but serve."""
    root = getattr(a, "root", None) or os.getcwd()
    if a.command == "index":
        return engine.index(a.path, a.db, reset=a.reset, definitions=a.definitions, force=a.force, log=lambda s: print(s, file=sys.stderr)), 0
    if a.command == "query":
        return engine.query(a.text, a.db, root=root, tokens=a.tokens, top=a.top, candidates=a.candidates, filter=a.filter, kind=a.kind, lang=a.lang, w_dense=a.w_dense, w_lexical=a.w_lexical), 0
    if a.command == "optimize":
        return engine.optimize(a.db, root=root), 0
    if a.command == "status":
        status = engine.status(a.db, root)
        return status, 1 if status["error"] else 0
    if a.command == "doctor":
        return engine.doctor(a.db, root), 0
    if a.command == "init":
        return bootstrap.init(engine, a.path, a.db, skip_index=a.skip_index, auto_index=a.auto_index, force=a.force, harness=a.harness), 0
    if a.action == "install":
        return {"status": "ok", "hook": bootstrap.install_hook()}, 0
    raise ValueError(f"unknown action {a.action!r}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.version:
        print(json.dumps({"codelode": __version__}))
        return 0
    if not a.command:
        p.print_help(sys.stderr)
        return 2
    if a.command == "hook" and a.action == "session-start":  # whatever goes wrong, a session starts
        print(json.dumps(bootstrap.session_start(lambda: Engine(spark or _session()), os.getcwd()), default=str))
        return 0
    try:
        model = getattr(a, "model", None)
        engine = Engine(spark or _session(), named_model(model, getattr(a, "batch", BATCH)) if model else None)
        if a.command == "serve":
            from codelode.server import serve

            where = Path(a.db or Path.cwd() / schema.INDEX_DIR)
            if Store(engine.spark, where).is_locked():
                raise LockedError(f"{where} is already open for writing; serve it when that is done")
            with bootstrap.ServerLock(where):
                serve(engine, a.db)
            return 0
        payload, code = run(a, engine)
    except FilterError as e:
        print(e, file=sys.stderr)
        return 2
    except (LockedError, IndexError_, UnsafeRootError, ValueError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1
    print(json.dumps(payload, indent=2, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
