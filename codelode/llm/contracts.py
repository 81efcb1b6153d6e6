"""Columns that the operators' contracts fix, as queries with DuckDB SQL that recomputes them from the tables.

Each query runs its operator over its whole table and keeps those columns; scores, labels and spans of
the methods are left out, as SQL has no word for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.llm import langid, licenses, quality, secrets
from codelode.llm._store import prepare


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and base places of every document."""
    return licenses.scan(_documents(spark, sf_dir)).drop("labels", "score")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of every document, and the base verdict."""
    docs = _documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model).drop("kept", "score")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans of every document."""
    docs = _documents(spark, sf_dir)
    return secrets.scan(docs, secrets.fit(docs)).drop("n_markov", "spans")


def language_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are held out, and which have no language."""
    docs = _documents(spark, sf_dir)
    model = langid.fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    return langid.predict(docs, model).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("undetermined"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (license_base, quality_base, secret_base, language_base)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _places(phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"w[k + {i}] = '{x}'" for i, x in enumerate(words))
    return f"list_filter(range(1, len(w) - {len(words) - 2}), lambda k: {same})"


_LICENSE = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {{docs}}),
found AS (SELECT doc_id, len(w) AS n_words, {", ".join(f"{_places(p)} AS p{k}" for k, (p, _) in enumerate(licenses.BASE))} FROM words),
every AS (SELECT *, {" || ".join(f"p{k}" for k in range(len(licenses.BASE)))} AS p FROM found)
SELECT doc_id, n_words, len(p) AS n_base, list_min(p) - 1 AS first_word, list_max(p) - 1 AS last_word,
  array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(licenses.BASE))}], lambda x: x IS NOT NULL)), ',') AS base_labels FROM every
"""

_QUALITY = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {docs}),
words AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT r, k, hash(w[k:k + 4]) AS h FROM words, unnest(range(1, len(w) - 3)) AS t(k)),
twice AS (SELECT r, h FROM windows GROUP BY r, h HAVING count(*) > 1),
repeats AS (SELECT r, count(DISTINCT k + j) AS n FROM windows SEMI JOIN twice USING (r, h), unnest(range(5)) AS t(j) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
counts AS (
  SELECT d.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, coalesce(x.n, 0) AS n_repeat_words
  FROM docs d JOIN words w USING (r) JOIN lines l USING (r) LEFT JOIN repeats x USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
"""

_ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _spans(kind: int, form: str, least: str) -> str:
    """Matches with their places: the pieces between them tell how far each is from the start."""
    return rf"""
  SELECT r, {kind} AS kind, first, first + length(m) AS after FROM (
    SELECT r, m, g, coalesce(sum(length(b) + length(m)) OVER (PARTITION BY r ORDER BY k) - length(m), 0) AS first FROM (
      SELECT r, unnest(regexp_extract_all(text, '{form}')) AS m, unnest(regexp_extract_all(text, '{form}', {2 if kind == 0 else 0})) AS g,
        unnest(regexp_split_to_array(text, '{form}')[1:len(regexp_extract_all(text, '{form}'))]) AS b, generate_subscripts(regexp_extract_all(text, '{form}'), 1) AS k FROM docs WHERE regexp_matches(text, '{form}')))
  WHERE {least}"""


_SECRET = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {{docs}}),
found AS ({_spans(0, _ASSIGN, "length(g) >= 6")} UNION ALL {_spans(1, "AKIA[A-Z0-9]+", "length(m) >= 20")} UNION ALL {_spans(2, "[0-9a-f]+", "length(m) >= 24")}),
joined AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || first::BIGINT || ':' || after::BIGINT, ',' ORDER BY first, kind) AS s FROM found GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256 FROM docs LEFT JOIN joined USING (r)
"""

_LANGUAGE = r"""
SELECT doc_id, doc_id IS NOT NULL AND xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id, 0)::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 3 = 1 AS held_out,
  text IS NULL OR NOT regexp_matches(text, '\p{{L}}') AS undetermined FROM {docs}
"""

ORACLE_SQL = {name: sql.format(docs="documents").strip() for name, sql in (("license_base", _LICENSE), ("quality_base", _QUALITY), ("secret_base", _SECRET), ("language_base", _LANGUAGE))}

#: op9's contract in full; {length} is the length of a repeat in bytes, which are pairs of hexadecimal digits here.
SUBSTRINGS = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM {docs}),
starts AS (SELECT r, i, hash(substr(h, 2 * i + 1, 2 * {length})) AS f FROM docs, unnest(range(length(h) // 2 - {length} + 1)) AS t(i)),
repeated AS (SELECT r, i FROM starts SEMI JOIN (SELECT f FROM starts GROUP BY f HAVING count(*) > 1) USING (f)),
islands AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS island FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {length} THEN 0 ELSE 1 END AS fresh FROM repeated)),
runs AS (SELECT r, min(i) AS a, max(i) + {length} AS b FROM islands GROUP BY r, island),
gaps AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before, max(b) OVER (PARTITION BY r) AS last FROM runs),
kept AS (SELECT r, any_value(last) AS last, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM gaps JOIN docs USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""
