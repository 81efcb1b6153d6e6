"""Scalar functions as column expressions; all run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The pattern of a query's tokens, of the hash embedder's, and of the token estimator.
QUERY_TOKEN = r"[A-Za-z_][A-Za-z0-9_]{1,}"
EMBED_TOKEN = r"[A-Za-z_][A-Za-z0-9_]+"
ESTIMATOR = "regex-v1"
ESTIMATOR_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\sA-Za-z0-9_]"
# Weights of the name and of the code in the lexical score; characters of code that are embedded.
NAME_WEIGHT, CODE_WEIGHT = 0.7, 0.3
EMBEDDED_CHARS = 2000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doc_id(file_path: str | Column = "file_path", symbol_name: str | Column = "symbol_name", kind: str | Column = "kind") -> Column:
    """The key of a symbol: SHA-1 of path, name and kind; it stays as lines move."""
    return F.sha1(F.concat_ws("::", col(file_path), col(symbol_name), col(kind)))


def embed_text(kind: str | Column = "kind", name: str | Column = "symbol_name", code: str | Column = "code_content") -> Column:
    """What is embedded of a symbol: its kind and name, and the first characters of its code."""
    return F.concat(col(kind), F.lit(" "), col(name), F.lit("\n"), F.substring(col(code), 1, EMBEDDED_CHARS))


def query_tokens(text: str) -> list[str]:
    """The distinct tokens of a query, in order of appearance."""
    return list(dict.fromkeys(t.lower() for t in re.findall(QUERY_TOKEN, text, re.ASCII)))


def query_tokens_column(text: str | Column) -> Column:
    """The same for a column of queries."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(QUERY_TOKEN), F.lit(0)), F.lower))


def lexical_score(tokens: list[str], name: str | Column = "symbol_name", code: str | Column = "code_content") -> Column:
    """Share of the tokens that are substrings of the name and of the code, weighted; one term for each token, so codegen applies."""
    if not tokens:
        return F.lit(0.0)

    def share(c: Column) -> Column:
        hits = F.lit(0)
        for t in tokens:
            hits = hits + F.when(c.contains(t), 1).otherwise(0)
        return hits / F.lit(float(len(tokens)))

    return F.least(F.lit(1.0), NAME_WEIGHT * share(F.lower(col(name))) + CODE_WEIGHT * share(F.lower(col(code))))


def lexical_score_column(tokens: str | Column, name: str | Column, code: str | Column) -> Column:
    """The same where the tokens are an array column."""

    def share(c: Column) -> Column:
        return F.size(F.filter(col(tokens), lambda t: c.contains(t))) / F.size(col(tokens))

    return F.when(F.size(col(tokens)) == 0, 0.0).otherwise(F.least(F.lit(1.0), NAME_WEIGHT * share(F.lower(col(name))) + CODE_WEIGHT * share(F.lower(col(code)))))


def estimate_tokens(text: str | Column) -> Column:
    """Identifiers, runs of digits and other characters but space, counted (Unicode digits and spaces are known as such)."""
    return F.regexp_count(col(text), F.lit(f"(?U){ESTIMATOR_TOKEN}"))


def reduction_percent(saved: str | Column, full: str | Column) -> Column:
    return F.when(col(full) > 0, F.round(col(saved) / col(full) * 100, 2)).otherwise(F.lit(0.0))


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def suffix(path: str | Column) -> Column:
    """The extension in lower case; names that begin with their only dot, or end in a dot, have none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1))


def slug(text: str | Column) -> Column:
    """Trimmed, without outer number signs, white space collapsed."""
    bare = F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")
    bare = F.regexp_replace(bare, r"^#+|#+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def compact_name(text: str | Column, strip_extension: bool = True) -> Column:
    """The last segment of a path, without its extension if asked, other characters than ``A-Za-z0-9_-`` as spaces."""
    base = F.substring_index(F.rtrim(slug(F.translate(col(text), "\\", "/")), F.lit("/")), "/", -1)
    if strip_extension:
        base = F.regexp_replace(base, r"\.[^.]*$", "")
    return slug(F.trim(F.regexp_replace(base, r"[^A-Za-z0-9_-]+", " ")))


def local_xml_name(tag: str | Column) -> Column:
    """A tag without its namespace or prefix."""
    return F.regexp_replace(col(tag), r"^.*[}:]", "")


# Fixed value: an attribute in a tag.
ATTRIBUTE = r"([A-Za-z_][\w.-]*)\s*=\s*(?:'([^']*)'|\"([^\"]*)\")"


def attributes(tag: str | Column) -> Column:
    """A map of a tag's attributes; of equal names the last counts."""
    found = F.regexp_extract_all(col(tag), F.lit(ATTRIBUTE), F.lit(0))
    pairs = F.transform(found, lambda a: F.struct(F.regexp_extract(a, ATTRIBUTE, 1).alias("k"), F.trim(F.concat(F.regexp_extract(a, ATTRIBUTE, 2), F.regexp_extract(a, ATTRIBUTE, 3))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def line_of(text: str | Column, offset: str | Column) -> Column:
    """The line, from 1, of a character offset, from 0."""
    head = F.substring(col(text), F.lit(1), col(offset))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def lines(text: str | Column) -> Column:
    """Lines the way text files are read here: every Unicode line end parts, and the last end starts no further line."""
    whole = F.regexp_replace(col(text), "\r\n?", "\n")
    parts = F.split(whole, "[\n\u000b\u000c\u001c\u001d\u001e\u0085  ]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def install_hint(extra: str | Column, installed: str | Column) -> Column:
    """How to get a grammar that is missing; null if it is there or always was."""
    return F.when(col(extra).isNotNull() & ~col(installed), F.concat(F.lit("pip install 'codelode["), col(extra), F.lit("]'")))
