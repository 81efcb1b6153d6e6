"""Approximate nearest neighbours by inner product: probed lists, scanned by adaptive dimensions.

Vectors are scaled by the largest norm and get one more component that makes their norm 1, and
queries are made units with 0 there, so the largest inner product is the least distance.  A
random rotation spreads distances evenly over the dimensions.

1. Equal vectors become one row with its ``top + 1`` least ids, as no more of them can be
   among a query's nearest; equal queries are searched once.
2. Centroids are fitted to a bounded sample of ``SAMPLE`` rows (those of least digest), and
   every row is put in the list of its nearest centroid.  The number of lists that a query
   probes is the least that holds ``RECALL`` of the true neighbours of ``TRIALS`` sampled
   rows; fewer rows than asked for in these lists are made up from the next.
3. Each query first scans its nearest list, which bounds the score that others must reach,
   and then the others.  A list is cut into tiles of at most ``TILE_BYTES``, and the queries
   of a much-probed tile into shares; a task holds one tile, and queries stream past it.
4. Distances are summed by blocks of ``BLOCK`` dimensions.  After each, a pair is abandoned
   if the distance seen so far says that the whole one is above the bound: after d of D
   dimensions the estimate may be off by a factor 1 + ``DOUBT`` / sqrt(d).  What is left is
   scored on the original vectors, in double precision, component by component.

Edge cases: vectors that are null, zero or empty or hold null or non-finite components
take no part, nor do rows with a null id; shorter vectors count as filled up with zeros;
a candidate with the query's own id is the query's own; equal rows are one; of rows with
one id and different vectors each is a candidate and, if the id says so, a query; equal
scores are ordered by vec_id; an empty table has no result.  Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode.llm import _kernel as K
from codelode.llm._join import meet
from codelode.llm._store import settle

#: Rows that the centroids are fitted to, rounds of that, lists at most; sampled queries, and the share of neighbours that their probes hold.
SAMPLE, ROUNDS, MOST_LISTS, TRIALS, RECALL = 32_768, 8, 2_048, 512, 0.97
#: Dimensions of a block, and the doubt of the hypothesis test in standard deviations.
BLOCK, DOUBT = 16, 2.1
#: Bytes of vectors in a tile, pairs that one task compares, bytes of rows for a task; queries and rows that are compared at once.
TILE_BYTES, TASK_PAIRS, TASK_BYTES, AT_ONCE, STEP = 32 << 20, 1 << 29, 8 << 20, 128, 2_048
#: The share of pairs up to which they are gathered one by one.
SPARSE = 0.25
_SEED = 20


@dataclass(frozen=True)
class Index:
    """What every task needs: the vectors' type, length and largest norm, the rotation, the centroids, lists to probe."""

    kind: str
    size: int
    scale: float
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int

    def vectors(self, column: pa.Array) -> np.ndarray:
        """Original vectors as doubles, filled up with zeros."""
        rows = [np.frombuffer(v, self.kind) for v in column.to_pylist()]
        out = np.zeros((len(rows), self.size))
        for k, v in enumerate(rows):
            out[k, : len(v)] = v
        return out

    def rotated(self, x: np.ndarray, queries: bool = False) -> np.ndarray:
        if queries:
            longest = np.abs(x).max(1, keepdims=True)
            x = x / longest
            more, x = np.zeros(len(x)), x / np.sqrt((x * x).sum(1, keepdims=True))
        else:
            x = x / self.scale
            more = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
        return np.column_stack([x, more]) @ self.rotation

    def distances(self, rotated: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids."""
        return (self.centroids * self.centroids).sum(1) - 2 * rotated @ self.centroids.T


def _fit(rows: pa.Table, kind: str, size: int, scale: float, n: int, top: int) -> Index:
    rng = np.random.default_rng(_SEED)
    rotation = np.linalg.qr(rng.standard_normal((size + 1, size + 1)))[0]
    index = Index(kind, size, scale, rotation, np.zeros((1, size + 1)), 1)
    x = index.vectors(rows["v"].combine_chunks())
    own = index.rotated(x)
    lists = max(1, min(MOST_LISTS, round(math.sqrt(n)), len(x) // 8))
    centroids = own[rng.choice(len(own), lists, replace=False)]
    for _ in range(ROUNDS):
        index = Index(kind, size, scale, rotation, centroids, 1)
        near = np.concatenate([index.distances(own[k : k + 4096]).argmin(1) for k in range(0, len(own), 4096)])
        order = np.argsort(near, kind="stable")
        found, at = np.unique(near[order], return_index=True)
        centroids = centroids.copy()
        centroids[found] = np.add.reduceat(own[order], at) / np.diff(np.append(at, len(own)))[:, None]
    index = Index(kind, size, scale, rotation, centroids, 1)
    near = np.concatenate([index.distances(own[k : k + 4096]).argmin(1) for k in range(0, len(own), 4096)])
    asked = index.rotated(x[:TRIALS], queries=True)
    places = []
    for k in range(0, len(asked), 64):
        scores = asked[k : k + 64] @ own.T
        scores[np.arange(len(scores)), np.arange(k, k + len(scores))] = -np.inf
        best = np.argsort(-scores, axis=1)[:, : min(top, len(own) - 1)]
        place = np.argsort(np.argsort(index.distances(asked[k : k + 64]), axis=1), axis=1)
        places.append(np.take_along_axis(place, near[best], 1).ravel())
    places = np.concatenate(places)
    probes = int(np.quantile(places, RECALL, method="higher")) + 1 if len(places) else 1
    return Index(kind, size, scale, rotation, centroids, probes)


# Rows ------------------------------------------------------------------------


def _packed(embeddings: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, v, norm, sig) of the vectors that take part, and the type of their components."""
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("e"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v, "f4" if single else "f8") for v in (x.values.to_numpy(zero_copy_only=False) for x in batch.column(1))]
            norms = []
            for v in vectors:
                longest = float(np.abs(v).max())
                norms.append(longest * math.sqrt(float(((v.astype("f8") / longest) ** 2).sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "v", "norm"])

    return rows.mapInArrow(K.frugal(pack), "vec_id long, v binary, norm double").withColumn("sig", F.unhex(F.md5("v"))), "f4" if single else "f8"


def _listed(rows: DataFrame, index) -> DataFrame:
    """rows with the list of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = index.value.rotated(index.value.vectors(batch.column(2)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.value.distances(x).argmin(1).astype(np.int32))], names=["sig", "ids", "v", "list"])

    return rows.select("sig", "ids", "v").mapInArrow(K.frugal(run), "sig binary, ids array<long>, v binary, list int")


def _probed(rows: DataFrame, index, held: np.ndarray, top: int) -> DataFrame:
    """(sig, v, lists): what each query probes, nearest first; held: ids in each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(index.value.distances(index.value.rotated(index.value.vectors(batch.column(1)), queries=True)), axis=1, kind="stable")
            enough = (np.cumsum(held[order], axis=1) <= top).sum(1) + 1
            lists = [[x for x in o[: max(index.value.probes, e)] if held[x]] for o, e in zip(order.tolist(), enough.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=["sig", "v", "lists"])

    return rows.select("sig", "v").mapInArrow(K.frugal(run), "sig binary, v binary, lists array<int>")


# The scan of a tile ------------------------------------------------------------


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last; shapes are broadcast."""
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for j in range(a.shape[-1]):
        total += a[..., j] * b[..., j]
    return total


def survivors(q: np.ndarray, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose distance may be within the bound of the query; partial distances abandon the others block by block."""
    size = q.shape[1]
    part, pairs = np.zeros((len(q), len(x))), None
    for a in range(0, size, BLOCK):
        b = min(a + BLOCK, size)
        qb, xb = q[:, a:b], x[:, a:b]
        # At the end the estimate is the distance itself; a hair is left for rounding.
        limit = bound * ((1 + DOUBT / math.sqrt(b)) ** 2 * b / size if b < size else 1) + 1e-12
        if pairs is None:
            part += (qb * qb).sum(1)[:, None] + (xb * xb).sum(1) - 2 * qb @ xb.T
            alive = part <= limit[:, None]
            if alive.sum() <= SPARSE * alive.size or b == size:
                pairs = np.nonzero(alive)
                part = part[pairs]
        else:
            part += ((qb[pairs[0]] - xb[pairs[1]]) ** 2).sum(1)
            alive = part <= limit[pairs[0]]
            pairs, part = (pairs[0][alive], pairs[1][alive]), part[alive]
    return pairs


class _Tile:
    """A tile's vectors; ``scan`` finds the best rows of it for queries."""

    def __init__(self, index: Index, batches: list[pa.RecordBatch], top: int) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        self.index, self.top = index, top
        self.own = index.vectors(table["v"].combine_chunks())
        self.rotated = index.rotated(self.own)
        ids = table["ids"].combine_chunks()
        self.ids, self.offs = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])

    def scan(self, own: np.ndarray, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, vec_id) of the top + 1 best that reach tau."""
        rotated, tau = self.index.rotated(own, queries=True), tau.copy()
        longest = np.abs(own).max(1)
        length = longest * np.sqrt(((own / longest[:, None]) ** 2).sum(1))
        q, s, i = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        for at in range(0, len(self.own), STEP):
            x = self.own[at : at + STEP]
            with np.errstate(invalid="ignore", over="ignore"):
                bound = np.where(np.isneginf(tau), np.inf, 2 - 2 * (tau / length) / self.index.scale)
            a, b = survivors(rotated, self.rotated[at : at + STEP], bound)
            if len(a) > SPARSE * len(own) * len(x):
                score = exact(own[:, None, :], x[None, :, :])[a, b]
            else:
                score = np.concatenate([np.empty(0), *(exact(own[a[k : k + 32_768]], x[b[k : k + 32_768]]) for k in range(0, len(a), 32_768))])
            good = score >= tau[a]
            a, b, score = a[good], b[good] + at, score[good]
            n = self.offs[b + 1] - self.offs[b]
            ids = self.ids[np.repeat(self.offs[b] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            q, s, i = np.concatenate([q, np.repeat(a, n)]), np.concatenate([s, np.repeat(score, n)]), np.concatenate([i, ids])
            order = np.lexsort((i, -s, q))
            q, s, i = q[order], s[order], i[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            kept = place <= self.top
            last = q[place == self.top]
            tau[last] = np.maximum(tau[last], s[place == self.top])
            q, s, i = q[kept], s[kept], i[kept]
        return q, s, i


def _scan(batches: Iterator[pa.RecordBatch], index: Index, top: int) -> Iterator[pa.RecordBatch]:
    """Units come in order, a unit's tile before its queries."""
    now, held, tile = None, [], None
    for batch in batches:
        unit = np.column_stack([batch.column(k).to_numpy() for k in range(4)])  # list, tile, share, kind
        edges = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]).any(1)))
        for a, b in zip(edges, np.append(edges[1:], len(unit)), strict=True):
            *key, kind = unit[a].tolist()
            part = batch.slice(a, b - a)
            if key != now:
                now, held, tile = key, [], None
            if kind == 0:
                held.append(part)
                continue
            if held:
                tile, held = _Tile(index, held, top), []
            for k in range(0, part.num_rows if tile else 0, AT_ONCE):
                some = part.slice(k, AT_ONCE)
                q, score, ids = tile.scan(index.vectors(some["v"]), some["tau"].to_numpy())
                yield pa.RecordBatch.from_arrays([some["sig"].take(pa.array(q)), pa.array(score), pa.array(ids)], names=["sig", "score", "vec_id"])


def _round(listed: DataFrame, probes: DataFrame, index, counts: dict[int, int], width: int, top: int) -> DataFrame:
    """(sig, score, vec_id): the best of each probed tile; probes: sig, v, tau, list."""
    tile_rows = max(STEP, TILE_BYTES // width)
    asked = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each list, at most MOST_LISTS
    tiles = {k: -(-n // tile_rows) for k, n in counts.items()}
    shares = {k: max(1, -(-n * min(counts.get(k, 0), tile_rows) // TASK_PAIRS)) for k, n in asked.items()}
    if not asked:
        return listed.sparkSession.createDataFrame([], "sig binary, score double, vec_id long")
    known = F.broadcast(listed.sparkSession.createDataFrame([(k, tiles[k], shares[k]) for k in asked], "list int, tiles int, shares int"))
    rows = listed.join(known, "list").withColumn("tile", F.pmod(F.xxhash64("sig"), F.col("tiles")).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    rows = rows.select("list", "tile", "share", F.lit(0).alias("kind"), "sig", "ids", "v", F.lit(None).cast("double").alias("tau"))
    past = probes.join(known, "list").withColumn("share", F.pmod(F.xxhash64("sig"), F.col("shares")).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    past = past.select("list", "tile", "share", F.lit(1).alias("kind"), "sig", F.lit(None).cast("array<long>").alias("ids"), "v", "tau")
    bytes_ = width * sum(counts[k] * shares[k] + n * tiles[k] for k, n in asked.items())
    tasks = max(1, -(-bytes_ // TASK_BYTES), -(-sum(n * counts[k] for k, n in asked.items()) // TASK_PAIRS))
    dealt = rows.unionByName(past).repartition(tasks, "list", "tile", "share").sortWithinPartitions("list", "tile", "share", "kind")
    return dealt.mapInArrow(K.frugal(lambda it: _scan(it, index.value, top)), "sig binary, score double, vec_id long")


def search(embeddings: DataFrame, queries: Column, top: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found for each row that ``queries`` (a condition on vec_id) picks."""
    spark = embeddings.sparkSession
    packed, kind = _packed(embeddings)
    least = F.dense_rank().over(Window.partitionBy("sig").orderBy("vec_id"))
    rows = settle(packed.withColumn("r", least).filter(F.col("r") <= top + 1).groupBy("sig").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("v").alias("v"), F.first("norm").alias("norm")))
    n, scale, width = rows.agg(F.count("*"), F.max("norm"), F.max(F.octet_length("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.select("sig", "v").orderBy("sig").limit(SAMPLE).toArrow()
    fitted = _fit(sample, kind, width // np.dtype(kind).itemsize, min(scale, 1.7e308), n, top)
    index = spark.sparkContext.broadcast(fitted)
    listed = settle(_listed(rows, index))
    counts, held = {}, np.zeros(len(fitted.centroids), np.int64)
    for r in listed.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect():  # at most MOST_LISTS rows
        counts[r["list"]], held[r["list"]] = r["n"], r["ids"]
    asked = settle(packed.filter(queries).select("vec_id", "sig").distinct())
    probed = settle(_probed(rows.join(asked.select("sig").distinct(), "sig", "left_semi"), index, held, top))
    first = settle(_round(listed, probed.select("sig", "v", F.lit(float("-inf")).alias("tau"), F.col("lists")[0].alias("list")), index, counts, width, top))
    tau = first.groupBy("sig").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("sig", F.when(F.size("s") > top, F.col("s")[top]).alias("tau"))  # of at most top + 1 for each tile
    others = probed.filter(F.size("lists") > 1).join(tau, "sig", "left").select("sig", "v", F.coalesce("tau", F.lit(float("-inf"))).alias("tau"), F.explode(F.slice("lists", 2, MOST_LISTS)).alias("list"))
    found = first.unionByName(_round(listed, settle(others), index, counts, width, top))
    order = Window.partitionBy("sig").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top + 1).groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    best = best.join(asked.groupBy("sig").agg(F.count("*").alias("rows")), "sig")
    own = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    answers = meet(asked.withColumnRenamed("vec_id", "query_id"), settle(best), ["sig"]).select("query_id", F.posexplode(own).alias("rank", "x"))
    return answers.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
