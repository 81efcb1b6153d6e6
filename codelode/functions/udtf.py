"""The extractors as a table function for SQL: ``SELECT ... FROM files, LATERAL carve(text, 'lines')``.

What it returns depends on its second argument, which must be a literal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

# Tokens of a name and of the estimator; headings, and fences that hide them.
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]+", re.ASCII)
_TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\sA-Za-z0-9_]")
_HEADING, _FENCE = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$"), re.compile(r"\s*(```|~~~)")

_COLUMNS = {
    "lines": {"symbol_name": StringType(), "kind": StringType(), "line": IntegerType()},
    "tokens": {"line": IntegerType(), "tokens": IntegerType()},
    "headings": {"line": IntegerType(), "level": IntegerType(), "title": StringType()},
    "tags": {"tag": StringType(), "line": IntegerType(), "self_closed": IntegerType()},
}


class Carve:
    """(text, what) to rows: lines with a name and a kind, tokens of each line, headings outside fences, or opening tags.

    A null text has no row; lines that are empty are left out, but count.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, what: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType) or text.isTable:
            raise ValueError("carve: the first argument is a text")
        if what.value not in _COLUMNS:
            raise ValueError(f"carve: the second argument is one of {', '.join(sorted(_COLUMNS))}")
        schema = StructType()
        for name, kind in _COLUMNS[what.value].items():
            schema = schema.add(name, kind)
        return AnalyzeResult(schema)

    def eval(self, text: str | None, what: str) -> Iterator[tuple]:
        return getattr(self, f"_{what}")(text) if text is not None else iter(())

    @staticmethod
    def _lines(text: str) -> Iterator[tuple]:
        kept = [(n, line) for n, line in enumerate(text.split("\n"), 1) if line]
        for k, (n, line) in enumerate(kept):
            found = _NAME.search(line)
            yield found.group() if found else "", "class" if k == 0 else "section" if k == len(kept) - 1 else "function", n

    @staticmethod
    def _tokens(text: str) -> Iterator[tuple]:
        for n, line in enumerate(text.split("\n"), 1):
            if line:
                yield n, sum(1 for _ in _TOKEN.finditer(line))

    @staticmethod
    def _headings(text: str) -> Iterator[tuple]:
        hidden = False
        for n, line in enumerate(text.split("\n"), 1):
            if _FENCE.match(line):
                hidden = not hidden
            elif not hidden and (found := _HEADING.match(line)):
                yield n, len(found[1]), found[2]

    @staticmethod
    def _tags(text: str) -> Iterator[tuple]:
        at, line = 0, 1
        for found in re.finditer(r"<([A-Za-z][A-Za-z0-9]*)[^>]*>", text):
            line, at = line + text.count("\n", at, found.start()), found.start()
            yield found[1].lower(), line, int(found[0].endswith("/>"))


def register(spark: SparkSession, name: str = "carve") -> None:
    """Makes the table function known to a session's SQL."""
    spark.udtf.register(name, F.udtf(Carve))
