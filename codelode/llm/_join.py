"""Joins on keys that a few values can dominate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows up to which a side of a join is sent to all tasks (under 100 bytes each).
SENT_ROWS = 10_000
#: Beyond it a key is hot with so many rows, and more than one in so many of all rows; hot keys are sent alone.
HOT_ROWS, HOT_KEYS = 1_000, 10_000


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with the settled right on keys (unique in right); rows: about how many rows of left a key has.

    Few rows of right are sent to all tasks.  Else both sides are shuffled, but for keys with more than
    ``HOT_ROWS`` rows and one in ``HOT_KEYS`` of all: no more than HOT_KEYS of them can be, and they are sent.
    """
    n, total, most = right.agg(F.count("*"), F.sum("rows"), F.max("rows")).first()
    bound = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    own = right.drop("rows")
    if n <= SENT_ROWS:
        return left.join(F.broadcast(own), keys, how)
    if most <= bound:
        return left.join(own, keys, how)
    hot = F.broadcast(right.filter(F.col("rows") > bound).drop("rows"))
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.filter(F.col("rows") <= bound).drop("rows"), keys, how)
    return rest if how == "left_anti" else rest.unionByName(left.join(hot, keys, "inner" if how == "left" else how))
