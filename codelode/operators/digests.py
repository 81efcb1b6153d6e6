"""Telling what changed from digests of groups, so that equal groups are never compared row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def bucket_of(path: str | Column, buckets: int) -> Column:
    """A bucket from 0 for each path, by the last 16 bits of its MD5, which any engine computes alike."""
    path = F.col(path) if isinstance(path, str) else path
    return (F.conv(F.right(F.md5(path.cast("binary")), F.lit(4)), 16, 10).cast("int") % buckets).cast("int")


def directory_of(path: str | Column, depth: int) -> Column:
    """The first segments of a path's directory."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1)), "/")


def digests(rows: DataFrame, group: list[str], compared: list[str]) -> DataFrame:
    """(group, n, a, b): how many rows each group has, and two 64-bit digests of them that no order changes.

    Rows that stand in a group several times count as often, as they are counted and summed (modulo 2 ** 62), not only xored.
    """
    one, two = F.xxhash64(*compared), F.xxhash64(F.lit("second"), *compared)
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.bit_xor(one).alias("a"), (F.sum(F.shiftrightunsigned(two, 32)) % (1 << 62)).alias("b"))


def differing(old: DataFrame, new: DataFrame, group: list[str], compared: list[str]) -> DataFrame:
    """(group, n_old, n_new) of the groups whose rows differ; a group that one side lacks has 0 there."""
    a, b = (digests(x, group, compared).select(*group, *(F.col(c).alias(f"{c}_{side}") for c in ("n", "a", "b"))) for x, side in ((old, "old"), (new, "new")))
    both = a.join(b, group, "full")
    same = F.col("n_old").eqNullSafe(F.col("n_new")) & F.col("a_old").eqNullSafe(F.col("a_new")) & F.col("b_old").eqNullSafe(F.col("b_new"))
    return both.filter(~same).select(*group, F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"))


#: Levels of the tree of digests: directories of one and of three segments, and buckets of paths in those.
DEPTHS, BUCKETS = (1, 3), 64
#: Groups up to which a level's differing ones are sent to all tasks (under 200 bytes each).
SENT = 10_000


def changes(old: DataFrame, new: DataFrame, path: str, compared: list[str]) -> DataFrame:
    """(path, change) of the rows that were added, changed or deleted; both sides have a path and what is compared.

    Digests are compared from the top down: directories, then deeper ones within those that differ, then buckets of
    paths.  Only rows of groups that differ at every level are joined by path.
    """
    levels = [[f"_d{k}"] for k in range(len(DEPTHS))] + [["_bucket"]]
    tagged = [side.select(path, *compared, *(directory_of(path, d).alias(f"_d{k}") for k, d in enumerate(DEPTHS)), bucket_of(path, BUCKETS).alias("_bucket")) for side in (old, new)]
    group: list[str] = []
    for level in levels:
        group = group + level
        apart = differing(*tagged, group, [path, *compared]).select(*group)
        few = apart.limit(SENT + 1).collect()
        if len(few) <= SENT:
            apart = F.broadcast(apart.sparkSession.createDataFrame(few, apart.schema))
        tagged = [side.join(apart, group, "left_semi") for side in tagged]
    a, b = (side.select(path, F.xxhash64(*compared).alias(name)) for side, name in zip(tagged, ("_old", "_new"), strict=True))
    both = a.join(b, path, "full").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(path, F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").otherwise("changed").alias("change"))
