"""Reconciling an index with what a tree holds now, and telling whether it is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode import schema
from codelode.functions import text as X


def last_wins(symbols: DataFrame, key: str = "id", order: str = "seq", descending: bool = True) -> DataFrame:
    """One row for each key, the one of the greatest (or least) order; rows are pre-aggregated before the shuffle."""
    pick = F.max_by if descending else F.min_by
    others = [c for c in symbols.columns if c != key]
    return symbols.groupBy(key).agg(pick(F.struct(*others), F.col(order)).alias("row")).select(key, *(F.col(f"row.{c}").alias(c) for c in others))


def first_rows(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order of several columns."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def diff(old: DataFrame, new: DataFrame, key: str = "id", compared: tuple[str, ...] = ("symbol_name", "kind", "language", "start_line", "end_line", "code_content")) -> DataFrame:
    """(key, file_path, change): inserted, updated, unchanged or deleted, by one full outer join on the key."""
    hashed = F.xxhash64(*compared)
    a = old.select(key, F.col("file_path").alias("old_path"), hashed.alias("old_hash"))
    b = new.select(key, F.col("file_path").alias("new_path"), hashed.alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "inserted").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("updated")
    return a.join(b, key, "full").select(key, F.coalesce("new_path", "old_path").alias("file_path"), change.alias("change"))


def counts(changes: DataFrame) -> DataFrame:
    """(file_path, upserted, deleted) of each file: rows that are written, changed or not, and rows that go."""
    return changes.groupBy("file_path").agg(F.count_if(F.col("change") != "deleted").alias("upserted"), F.count_if(F.col("change") == "deleted").alias("deleted"))


def orphans(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(file_path) of stored files that are not current any more."""
    return stored.select("file_path").distinct().join(current.select("file_path"), "file_path", "left_anti")


def stale_flags(disk: DataFrame, indexed: DataFrame, last_indexed: float | Column, indexable: set[str], indexed_extensions: set[str] | None, relevant: set[str] | None = None) -> DataFrame:
    """(rel, newer, new_extension, changed, deleted, added) of every file on disk or in the index.

    disk: rel, sha1, mtime; indexed: rel, sha1.  A disk file whose suffix is neither indexable nor that of an
    indexed file only counts as newer.
    """
    d = disk.select("rel", F.col("sha1").alias("disk_sha1"), "mtime", F.lit(True).alias("on_disk"))
    i = indexed.select("rel", F.col("sha1").alias("old_sha1"), F.lit(True).alias("was_indexed"))
    both = d.join(i, "rel", "full").withColumn("ext", X.suffix("rel"))
    on_disk, was = F.col("on_disk").isNotNull(), F.col("was_indexed").isNotNull()
    can = F.col("ext").isin(*sorted(indexable)) if indexable else F.lit(False)
    counted = on_disk & (can | was)
    last = last_indexed if isinstance(last_indexed, Column) else F.lit(last_indexed)
    fresh_ext = can & ~F.col("ext").isin(*sorted(indexed_extensions)) if indexed_extensions is not None else F.lit(False)
    return both.select(
        "rel",
        F.coalesce(on_disk & (F.col("mtime") > last), F.lit(False)).alias("newer"),
        (on_disk & fresh_ext).alias("new_extension"),
        (counted & was & ~F.col("old_sha1").eqNullSafe(F.col("disk_sha1"))).alias("changed"),
        (was & ~on_disk).alias("deleted"),
        (on_disk & can & ~was).alias("added"),
    )


def is_stale(flags: DataFrame) -> DataFrame:
    """One row: whether any file is a reason to index again."""
    return flags.agg(F.coalesce(F.bool_or(F.col("newer") | F.col("new_extension") | F.col("changed") | F.col("deleted") | F.col("added")), F.lit(False)).alias("stale"))


def summary(symbols: DataFrame) -> DataFrame:
    """One row: documents, distinct files and sorted languages of an index."""
    return symbols.agg(F.count("*").alias("documents"), F.countDistinct("file_path").alias("files"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("language") != "", F.col("language")))), ",").alias("languages"))


def with_ids(symbols: DataFrame) -> DataFrame:
    return symbols.select(X.doc_id().alias("id"), *schema.SYMBOL_COLUMNS, *(["seq"] if "seq" in symbols.columns else []))


def by_language(symbols: DataFrame) -> DataFrame:
    """(language, documents, files, names) of an index: exact counts, and a sketch of the distinct names.

    A file has one language, so files add up; names do not, but their sketches can be merged.
    """
    return symbols.groupBy("language").agg(F.count("*").alias("documents"), F.countDistinct("file_path").alias("files"), F.hll_sketch_agg("symbol_name", F.lit(14)).alias("names"))


def merged(parts: DataFrame) -> DataFrame:
    """One row of such parts: documents, files, sorted languages, and an estimate of the distinct names (within 3 %)."""
    languages = F.array_join(F.sort_array(F.collect_set(F.when(F.col("language") != "", F.col("language")))), ",")
    names = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("names")), F.lit(0))
    return parts.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), languages.alias("languages"), names.alias("names"))
