"""Symbols of the driver's documents: a row for each line that is not empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode import schema
from codelode.functions import text as X
from codelode.operators.reconcile import last_wins
from codelode.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def extracted(docs: DataFrame) -> DataFrame:
    """EXTRACTED rows with id: the first line of a document is a class, the last a section, others functions.

    Lines are numbered and told apart within their own row, so nothing is shuffled.
    """
    numbered = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line"))), lambda x: x["line"] != "")
    path = F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    rows = docs.select(path.alias("file_path"), F.col("lang").alias("language"), numbered.alias("kept")).select("file_path", "language", F.size("kept").alias("n_kept"), F.posexplode_outer("kept").alias("seq", "k")).filter("k is not null")
    kind = F.when(F.col("seq") == 0, "class").when(F.col("seq") == F.col("n_kept") - 1, "section").otherwise("function")
    symbols = rows.select("file_path", F.regexp_extract("k.line", X.EMBED_TOKEN, 0).alias("symbol_name"), kind.alias("kind"), "language", F.col("k.n").alias("start_line"), F.col("k.n").alias("end_line"), F.col("k.line").alias("code_content"), "seq")
    return symbols.select(X.doc_id().alias("id"), *schema.SYMBOL_COLUMNS, "seq")


def _last_of_each(docs: DataFrame) -> DataFrame:
    """``last_wins(extracted(docs))`` for documents with paths of their own: equal keys stand in one row, and never move.

    A row's lines are ordered by name, kind and place; those that the next does not share name and kind with are the last.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    path = F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    rows = docs.select(path.alias("file_path"), F.col("lang").alias("language"), F.filter(lines, lambda x: x["line"] != "").alias("kept"))
    rows = rows.select("*", F.size("kept").alias("n_kept"))
    kind = lambda i: F.when(i == 0, "class").when(i == F.col("n_kept") - 1, "section").otherwise("function")
    named = F.transform("kept", lambda k, i: F.struct(F.regexp_extract(k["line"], X.EMBED_TOKEN, 0).alias("symbol_name"), kind(i).alias("kind"), k["n"].alias("n"), k["line"].alias("line")))
    rows = rows.select("file_path", "language", F.array_sort(named).alias("s"))
    both = F.zip_with("s", F.slice("s", F.lit(2), F.size("s")), lambda a, b: F.when(b.isNull() | (a["symbol_name"] != b["symbol_name"]) | (a["kind"] != b["kind"]), a))
    rows = rows.select("file_path", "language", F.explode(both).alias("x")).filter("x is not null")
    found = rows.select("file_path", "x.symbol_name", "x.kind", "language", F.col("x.n").alias("start_line"), F.col("x.n").alias("end_line"), F.col("x.line").alias("code_content"))
    return found.select(X.doc_id().alias("id"), *schema.SYMBOL_COLUMNS)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of all documents, of equal keys the last.

    Keys hold the path.  If every document has a path of its own, which a look at three narrow columns tells, documents
    are dealt evenly (a file of one row group is one task's otherwise) and symbols stay where they are made; else these are shuffled by key.
    """
    docs = table(spark, sf_dir, "documents")
    repeated = docs.groupBy("source", "doc_id", "lang").count().filter("count > 1").limit(1).count()
    return last_wins(extracted(docs)).drop("seq") if repeated else _last_of_each(docs.repartition("doc_id"))


#: The same in DuckDB's dialect, as common table expressions; ``s1`` has equal keys still.
SYM = r"""
raw AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS up, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS down FROM raw WHERE line <> ''),
s0 AS (
  SELECT source || '/doc_' || doc_id || '.' || lang AS file_path, regexp_extract(line, '[A-Za-z_][A-Za-z0-9_]+') AS symbol_name,
    CASE WHEN up = 1 THEN 'class' WHEN down = 1 THEN 'section' ELSE 'function' END AS kind, lang AS language,
    n AS start_line, n AS end_line, line AS code_content FROM k),
s1 AS (SELECT sha1(file_path || '::' || symbol_name || '::' || kind) AS id, * FROM s0),
sym AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY start_line DESC) = 1)"""
