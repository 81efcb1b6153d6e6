"""What the jobs share: configuration, settings for a while, and the command line."""

from __future__ import annotations

import argparse
import contextlib
import json
import logging
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession


def config(name: str, given: str | None = None) -> dict:
    """The settings of jobs/<name>.json, with those of another file over them."""
    own = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    more = json.loads(Path(given).read_text()) if given else {}
    if unknown := more.keys() - own.keys():
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return own | more


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (with _ for .) that hold inside, and are as before afterwards."""
    names = {k: k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    try:
        for k, v in values.items():
            spark.conf.set(names[k], v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def main(name: str, purpose: str, paths: dict[str, str], run: Callable[..., dict]) -> None:
    """The command line: a path for each of ``paths`` and --config; the session lives as long as the run."""
    parser = argparse.ArgumentParser(prog=f"jobs/{name}.py", description=purpose)
    for path, what in paths.items():
        parser.add_argument(f"--{path}", required=True, help=what)
    parser.add_argument("--config", help=f"a JSON file whose settings replace those of jobs/{name}.json")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **{p: args[p] for p in paths}, config=config(name, args["config"]))
    finally:
        spark.stop()
