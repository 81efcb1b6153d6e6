"""Filtered dense top-K with a lexical re-rank, and the report on saved tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode import schema
from codelode.functions import text as X

# Weights of the two scores, hits and size of the pool.
DENSE_WEIGHT, LEXICAL_WEIGHT, TOP, CANDIDATES = 0.7, 0.3, 3, 30

_LEXEMES = re.compile(r"\s*(?:(?P<string>'(?:[^']|'')*')|(?P<number>[+-]?\d+(?:\.\d+)?)|(?P<op><>|!=|<=|>=|<|>|=(?!=)|\(|\)|,)|(?P<word>[A-Za-z_]\w*))")
_KEYWORDS = {"and", "or", "not", "in", "like", "is", "null", "between"}


class FilterError(ValueError):
    """A filter that the engine does not accept."""


def check_filter(raw: str) -> str:
    """The filter itself, if it is made of comparisons of symbol columns and literals with AND, OR, NOT, IN, LIKE,
    BETWEEN, IS NULL and parentheses; functions, subqueries, ``==`` and all else raise FilterError."""
    at, depth, previous = 0, 0, ""
    while at < len(raw.rstrip()):
        m = _LEXEMES.match(raw, at)
        if not m:
            raise FilterError(f"unexpected {raw[at : at + 12].strip()!r} in filter")
        token = m.group().strip()
        if m["word"]:
            if token.lower() not in _KEYWORDS and token.lower() not in schema.SYMBOL_COLUMNS:
                raise FilterError(f"unknown name {token!r} in filter")
        elif token == "(":
            depth += 1
            if previous and previous.lower() in schema.SYMBOL_COLUMNS:
                raise FilterError("functions are not allowed in a filter")
        elif token == ")":
            depth -= 1
            if depth < 0:
                raise FilterError("unbalanced parentheses in filter")
        previous, at = token, m.end()
    if depth:
        raise FilterError("unbalanced parentheses in filter")
    return raw


def build_filter(raw: str | None = None, kind: str | None = None, lang: str | None = None) -> str | None:
    """One filter of a raw one and the shortcuts; empty parts are absent, None if all are."""
    parts = [f"({raw})"] if raw else []
    for name, value, known in (("kind", kind, schema.KINDS), ("language", lang, schema.LANGUAGE_NAMES)):
        if value:
            if value not in known:
                raise FilterError(f"unknown {name} {value!r}; one of {', '.join(known)}")
            parts.append(f"{name} = '{value}'")
    if raw:
        check_filter(raw)
    if len(parts) == 1 and raw:
        return raw
    return " AND ".join(parts) or None


def filtered(symbols: DataFrame, sql_filter: str | None) -> DataFrame:
    return symbols.filter(F.expr(check_filter(sql_filter))) if sql_filter else symbols


def dense_topk(rows: DataFrame, similarity: Column, k: int, tie: str = "id", digits: int | None = None) -> DataFrame:
    """The k rows of the greatest similarity (negative counts as 0), ties by ``tie``, with dense_similarity; each task keeps k."""
    value = F.greatest(F.lit(0.0), similarity)
    return rows.withColumn("dense_similarity", F.round(value, digits) if digits is not None else value).orderBy(F.desc("dense_similarity"), tie).limit(k)


def hybrid_query(symbols: DataFrame, similarity: Column, query_text: str, *, top: int = TOP, candidates: int = CANDIDATES, sql_filter: str | None = None, w_dense: float = DENSE_WEIGHT, w_lexical: float = LEXICAL_WEIGHT, digits: int | None = None) -> DataFrame:
    """Hits: the pool of max(candidates, top) rows by similarity, re-ranked with the lexical score.

    symbols: id and the symbol columns, and what similarity reads.  The filter comes before the pool, so
    every hit passes it.  Only the pool is ranked in one task.
    """
    if top < 0 or candidates < 0:
        raise ValueError("top and candidates are not negative")
    pool = dense_topk(filtered(symbols, sql_filter), similarity, max(candidates, top), digits=digits)
    # One projection: Spark moves projections below the pool's limit, and with two there it sorts all rows instead of keeping a few in each task.
    lex = X.lexical_score(X.query_tokens(query_text))
    scored = pool.select("*", lex.alias("lex"), (F.lit(w_dense) * F.col("dense_similarity") + F.lit(w_lexical) * lex).alias("final"))
    order = [F.desc("final"), F.desc("dense_similarity"), F.asc("id")]
    hits = scored.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return hits.select("rank", F.round("final", 4).alias("score"), F.round("dense_similarity", 4).alias("dense_similarity"), F.round("lex", 4).alias("lexical_score"), *schema.SYMBOL_COLUMNS)


def token_rows(hits: DataFrame) -> DataFrame:
    """(rank, file_path, symbol_name, snippet_tokens) of hits."""
    return hits.select("rank", "file_path", "symbol_name", X.estimate_tokens("code_content").alias("snippet_tokens"))


def token_files(hits: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, full_file_tokens, reason): each file with a hit once; files: file_path, text, and unreadable if known."""
    known = files if "unreadable" in files.columns else files.withColumn("unreadable", F.lit(False))
    paths = F.broadcast(hits.select("file_path").distinct())  # a query's hits are few
    wanted = known.select("file_path", "text", "unreadable", F.lit(True).alias("there")).join(paths, "file_path", "left_semi")
    found = hits.select("file_path").distinct().join(wanted, "file_path", "left")
    reason = F.when(F.col("there").isNull(), "not_found").when(F.col("unreadable"), "unreadable")
    return found.select("file_path", F.when(reason.isNull(), X.estimate_tokens("text")).alias("full_file_tokens"), reason.alias("reason"))


def token_savings(hits: DataFrame, files: DataFrame) -> DataFrame:
    """One row: tokens of the snippets and of the files that hold them, and what the snippets save."""
    snippets = token_rows(hits).agg(F.coalesce(F.sum("snippet_tokens"), F.lit(0)).cast("long").alias("snippet_tokens"))
    whole = token_files(hits, files).agg(F.coalesce(F.sum("full_file_tokens"), F.lit(0)).cast("long").alias("full_file_tokens"))
    both = snippets.crossJoin(whole).withColumn("saved_tokens", F.greatest(F.lit(0), F.col("full_file_tokens") - F.col("snippet_tokens")).cast("long"))
    return both.select(F.lit(X.ESTIMATOR).alias("estimator"), "snippet_tokens", "full_file_tokens", "saved_tokens", X.reduction_percent("saved_tokens", "full_file_tokens").alias("reduction_percent"))
