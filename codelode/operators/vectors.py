"""Top-K over vectors: many queries at once as products of blocks, and a layout by centroids that exact search can prune.

Both score inner products in double precision, component by component from the first, so that
results do not depend on how rows fall into tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Bytes of queries that are sent to all tasks at a time, rows of a tile, and the share of a tile beyond which it is scored whole.
QUERY_BYTES, TILE, DENSE = 8 << 20, 1_024, 0.05
#: A hair by which fast products may differ from exact ones, relative to the lengths of both vectors.
SLACK = 1e-9


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long vectors as doubles; a null or another length is an error."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = set(pc.list_value_length(column).to_pylist())
    if len(lengths) > 1 or None in lengths:
        raise ValueError(f"vectors of one length are needed, not of {sorted(map(str, lengths))}")
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return np.asarray(values, np.float64).reshape(len(column), -1)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the last axes, summed from the first component to the last; shapes are broadcast."""
    total = np.zeros(np.broadcast_shapes(x.shape[:-1], q.shape[:-1]))
    for j in range(x.shape[-1]):
        total += x[..., j] * q[..., j]
    return total


def similarity(score: np.ndarray, digits: int | None) -> np.ndarray:
    """Products below 0 count as 0; rounded half up if asked."""
    score = np.maximum(score, 0.0)
    return score if digits is None else np.floor(score * 10**digits + 0.5) / 10**digits


def keys(column: pa.Array) -> np.ndarray:
    """Ids, longs or strings, in the order that Spark has for them."""
    return column.to_numpy() if pa.types.is_integer(column.type) else np.array(column.to_pylist(), dtype=str)


class _Best:
    """The k best (similarity, id) of each query so far: a bounded heap for each, kept as sorted rows."""

    def __init__(self, queries: np.ndarray, k: int, digits: int | None) -> None:
        self.queries, self.k, self.digits = queries, k, digits
        self.length = np.sqrt((queries * queries).sum(1))
        self.query, self.score, self.id = np.empty(0, np.int64), np.empty(0), None
        self.least = np.full(len(queries), -np.inf)  # what a row must reach, once k are known

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        self.id = ids[:0] if self.id is None else self.id
        fast = self.queries @ x.T
        margin = SLACK * self.length[:, None] * np.sqrt((x * x).sum(1)) + (0.0 if self.digits is None else 10.0**-self.digits)
        a, b = np.nonzero(np.maximum(fast, 0) + margin >= self.least[:, None])
        if len(a) > DENSE * fast.size:
            exact = products(x[None, :, :], self.queries[:, None, :])[a, b]
        else:
            exact = products(x[b], self.queries[a])
        score = similarity(exact, self.digits)
        good = score >= self.least[a]
        query, score, id_ = (np.concatenate(c) for c in ((self.query, a[good]), (self.score, score[good]), (self.id, ids[b[good]])))
        order = np.lexsort((id_, -score, query))
        query, score, id_ = query[order], score[order], id_[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.score, self.id = query[kept], score[kept], id_[kept]
        full = place == self.k - 1
        self.least[query[full]] = score[full]


def batched_topk(rows: DataFrame, queries: DataFrame, k: int, *, id: str, vector: str, by: str, query: str, digits: int | None = None) -> DataFrame:
    """(by, id, rank, dense_similarity): the k best rows for each of a stated set of queries, ranked from 1, ties by id.

    Queries are sent to all tasks in blocks of QUERY_BYTES.  A task multiplies a block with one tile of its rows after
    the other and keeps k rows for each query, so no pair ever becomes a row: a task returns k rows for each query at
    most, which one shuffle ranks.  Ids are longs; vectors have one length, and products below 0 count as 0.
    """
    if k < 0:
        raise ValueError("k is not negative")
    spark = rows.sparkSession
    kind = rows.schema[id].dataType.simpleString(), queries.schema[by].dataType.simpleString()
    schema = f"{by} {kind[1]}, {id} {kind[0]}, dense_similarity double"
    n, width = queries.agg(F.count("*"), F.max(F.size(query))).first()
    blocks = -(-n * (width or 0) * 8 // QUERY_BYTES)

    def best(block: int) -> DataFrame:
        own = queries.filter(F.pmod(F.xxhash64(by), F.lit(blocks)) == block).select(by, query).orderBy(by).toArrow()
        known = spark.sparkContext.broadcast((own.column(0).combine_chunks(), matrix(own.column(1))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = known.value
            found = _Best(q, k, digits)
            for batch in batches:
                if batch.num_rows:
                    ids, x, type_ = keys(batch.column(0)), matrix(batch.column(1)), batch.column(0).type
                    for at in range(0, len(ids), TILE):
                        found.add(x[at : at + TILE], ids[at : at + TILE])
            for at in range(0, len(found.query), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(found.query[part])), pa.array(found.id[part].tolist(), type_), pa.array(found.score[part])], names=[by, id, "dense_similarity"])

        return rows.select(id, vector).mapInArrow(run, schema)

    if not blocks or not k:
        return spark.createDataFrame([], f"{by} {kind[1]}, {id} {kind[0]}, rank int, dense_similarity double")
    every = reduce(DataFrame.unionByName, (best(b) for b in range(blocks)))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("dense_similarity"), id)))
    return ranked.filter(F.col("rank") <= k).select(by, id, "rank", "dense_similarity")


# A layout by centroids ----------------------------------------------------------

#: Rows that the centroids are fitted to, rounds of that, the most lists, and rows that a list has at the least on average.
SAMPLE, ROUNDS, MOST_LISTS, LIST_ROWS = 20_000, 10, 1_024, 1_000


@dataclass(frozen=True)
class Lists:
    """Centroids, of each list how many rows it has and how far its farthest row is, and the rows' schema."""

    centroids: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    schema: str


def _fit(x: np.ndarray, lists: int) -> np.ndarray:
    centroids = x[np.random.default_rng(1).choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(x, centroids)[0]
        order = np.argsort(near, kind="stable")
        found, at = np.unique(near[order], return_index=True)
        centroids = centroids.copy()
        centroids[found] = np.add.reduceat(x[order], at) / np.diff(np.append(at, len(x)))[:, None]
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and how far it is."""
    near = np.concatenate([((centroids * centroids).sum(1) - 2 * x[k : k + 4_096] @ centroids.T).argmin(1) for k in range(0, len(x), 4_096)] or [np.empty(0, np.int64)])
    return near, np.sqrt(((x - centroids[near]) ** 2).sum(1))


def write_lists(rows: DataFrame, path: str, *, id: str, vector: str, lists: int | None = None) -> Lists:
    """Writes rows to ``path``/rows, partitioned by the list of the nearest centroid and ordered by distance to it.

    Centroids are fitted to the SAMPLE rows of least hash of the id.  Columns ``list`` and ``distance`` are added, and
    ``path``/lists has a row for each list.
    """
    n = rows.count()
    sample = matrix(rows.orderBy(F.xxhash64(id), id).limit(SAMPLE).select(vector).toArrow().column(0)) if n else np.zeros((0, 1))
    lists = max(1, min(lists or n // LIST_ROWS, MOST_LISTS, len(sample)))
    centroids = _fit(sample, lists) if n else np.zeros((1, 1))
    known, at = rows.sparkSession.sparkContext.broadcast(centroids), rows.columns.index(vector)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, far = _nearest(matrix(batch.column(at)), known.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far), pa.array(near.astype(np.int32))], names=[*batch.schema.names, "distance", "list"])

    listed = rows.mapInArrow(run, f"{fields}, distance double, list int")
    listed.repartition("list").sortWithinPartitions("list", "distance", id).write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    schema = f"{fields}, distance double, list int"
    stored = rows.sparkSession.read.schema(schema).parquet(f"{path}/rows")
    sizes = {r["list"]: r for r in stored.groupBy("list").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}  # at most MOST_LISTS
    told = [(k, sizes[k]["n"] if k in sizes else 0, sizes[k]["radius"] if k in sizes else 0.0, c.tolist(), schema) for k, c in enumerate(centroids)]
    rows.sparkSession.createDataFrame(told, "list int, n long, radius double, centroid array<double>, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    return Lists(centroids, np.array([t[1] for t in told]), np.array([t[2] for t in told]), schema)


def read_lists(spark: SparkSession, path: str) -> Lists:
    told = sorted(spark.read.parquet(f"{path}/lists").collect())
    return Lists(np.array([t["centroid"] for t in told]), np.array([t["n"] for t in told]), np.array([t["radius"] for t in told]), told[0]["schema"])


def _scored(spark: SparkSession, path: str, known: Lists, lists: list[int], query: np.ndarray, k: int, *, id: str, vector: str, least: dict[int, float] | None = None, digits: int | None = None) -> DataFrame:
    """(id, dense_similarity): the k best rows of each task of some lists; least: the distances from which their rows can count."""
    rows = spark.read.schema(known.schema).parquet(f"{path}/rows").filter(F.col("list").isin(lists))
    if least:
        from_ = [max(0.0, least.get(x, 0.0)) for x in range(len(known.rows))]
        rows = rows.filter(F.col("distance") >= min(from_[x] for x in lists)).filter(F.col("distance") >= F.get(F.lit(from_), F.col("list")))  # Parquet sees the first
    kind = rows.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Best(query[None, :], k, digits)
        for batch in batches:
            if batch.num_rows:
                found.add(matrix(batch.column(1)), keys(batch.column(0)))
                type_ = batch.column(0).type
        if len(found.query):
            yield pa.RecordBatch.from_arrays([pa.array(found.id.tolist(), type_), pa.array(found.score)], names=[id, "dense_similarity"])

    return rows.select(id, vector).mapInArrow(run, f"`{id}` {kind}, dense_similarity double")


def topk(spark: SparkSession, path: str, query: list[float], k: int, *, id: str, vector: str, probes: int | None = None, digits: int | None = None) -> DataFrame:
    """(id, dense_similarity) of the k best rows of a layout, ties by id; exact unless ``probes`` says how many lists are read.

    A row at distance d of its centroid c scores q.c + |q| d at most.  The lists of the best bounds that hold k rows are
    read first; their k-th score tells which lists, and within those from which distance on, rows can still count.
    Partitions of other lists are not read, and the distances reach Parquet as filters.
    """
    known, q = read_lists(spark, path), np.asarray(query, np.float64)
    length = float(np.sqrt((q * q).sum()))
    middle = known.centroids @ q
    bound = np.where(known.rows > 0, middle + length * known.radius, -np.inf)
    order = [x for x in np.argsort(-(middle if probes else bound), kind="stable").tolist() if known.rows[x]]
    best = lambda df: df.orderBy(F.desc("dense_similarity"), id).limit(k)
    options = {"id": id, "vector": vector, "digits": digits}
    if probes or not order or not k:
        return best(_scored(spark, path, known, order[: probes or 1] if k else [], q, max(k, 1), **options))
    first = order[: int(np.searchsorted(np.cumsum(known.rows[order]), k)) + 1]
    held = best(_scored(spark, path, known, first, q, k, **options)).collect()  # k rows
    slack = SLACK * length * (1 + float(np.abs(known.centroids).max())) + (0.0 if digits is None else 10.0**-digits)
    least = held[-1]["dense_similarity"] - slack if len(held) == k else 0.0
    rest = [x for x in order[len(first) :] if least <= 0 or bound[x] >= least]
    found = spark.createDataFrame(held, best(_scored(spark, path, known, [], q, k, **options)).schema)
    if not rest:
        return best(found)
    need = {x: float((least - middle[x]) / length) - SLACK for x in rest} if least > 0 and length > 0 else None
    return best(found.unionByName(_scored(spark, path, known, rest, q, k, least=need, **options)))


def pruned(spark: SparkSession, path: str, query: list[float], k: int, score: float) -> list[int]:
    """The lists whose bound reaches a score: what an exact search for it reads."""
    known, q = read_lists(spark, path), np.asarray(query, np.float64)
    bound = known.centroids @ q + np.sqrt((q * q).sum()) * known.radius
    return [x for x in np.flatnonzero((known.rows > 0) & (bound >= score)).tolist()]


def described(known: Lists) -> str:
    """A line for logs."""
    return json.dumps({"lists": len(known.rows), "rows": int(known.rows.sum()), "largest": int(known.rows.max(initial=0)), "radius": round(float(known.radius.mean()), 3)})
