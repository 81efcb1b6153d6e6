"""The corpus operators' queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.llm import contracts, decontam, jaccard, langid, licenses, line_dedup, neighbours, packing, pii, quality, secrets, substring, trie
from codelode.llm._store import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, the recurring ones among them, and the digest of what is kept."""
    return line_dedup.scan(_table(spark, sf_dir, "documents"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and the values of each kind that it held."""
    return pii.scan(_table(spark, sf_dir, "documents"))


def op3_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, its base phrases, and the labels of all templates that it matches."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts, and the verdict of the ratio of trusted and raw text."""
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op5_packing_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and where they stand in the sequences."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and the component that links put it in."""
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op7_secret_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans of secrets, by the fixed patterns and by the models."""
    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op8_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    seen = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return langid.predict(docs, langid.fit(seen))


def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, those that repeat, and the digest of the rest."""
    return substring.digest(_table(spark, sf_dir, "documents"))


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that leaks into it."""
    return decontam.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_adaptive_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20, among all vectors."""
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, top=20)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return trie.nodes(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_templates, op2_pii_pseudonyms, op3_license_templates, op4_quality_ratio, op5_packing_nnls, op6_shingle_join, op7_secret_models, op8_language_families, op9_repeated_substrings, op10_benchmark_leaks, op11_adaptive_neighbours, op12_conversation_trie)} | contracts.QUERIES
ORACLE_SQL: dict[str, str] = {
    "op1_line_templates": line_dedup.SQL.format(docs="documents"),
    "op6_shingle_join": jaccard.SQL.format(docs="documents"),
    "op9_repeated_substrings": contracts.SUBSTRINGS.format(docs="documents", length=substring.LENGTH),
    "op12_conversation_trie": trie.SQL.format(turns="conversations"),
} | contracts.ORACLE_SQL
