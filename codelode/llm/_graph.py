"""Connected components of graphs that are too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codelode.llm import _kernel as K
from codelode.llm._store import settle


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of these edges that are not roots; a root is its component's least node."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    inner = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[inner], nodes[root[inner]]


#: Edges, once contracted by partition, up to which one task finishes the work (16 bytes each); beyond, all tasks share it in rounds.
ONE_TASK = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as a forest of stars: (node, least node), no more rows than nodes."""
    known = [b for b in batches if b.num_rows]
    if known:
        node, root = forest(*(np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in known]) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])


def components(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges (a, b) of longs; root is the least node that links reach.

    Each partition's edges are contracted first.  If what is left is small (its size is checked) one task
    contracts it; else large-star and small-star steps alternate (each edge moves to the least neighbour)
    until nothing changes, which takes a number of rounds that grows with the logarithm of the graph's size.
    Each round is settled in the shared folder.
    """
    edges = settle(edges.filter("a <> b").mapInArrow(K.frugal(_contract), "a long, b long"))
    if edges.count() <= (ONE_TASK if one_task is None else one_task):
        edges = settle(edges.coalesce(1).mapInArrow(K.frugal(_contract), "a long, b long"))
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    edges = edges.distinct()
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        edges = settle(small)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first())
        if state == seen:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
