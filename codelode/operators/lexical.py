"""Which rows contain which tokens, by an inverted index of three-character pieces.

Rows are dealt to blocks by a hash of their id and stored in the order of blocks.  The postings of a piece are the
blocks that hold it, so the index is a fraction of the texts however often a piece occurs.  A piece is a long of three
code points, 21 bits each; postings are ordered by piece, so that a piece's stand in few row groups.  A look-up
intersects the blocks of a token's rarest pieces, reads the blocks that are left, and runs one automaton (Aho and
Corasick's) over each text there for all tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of a piece, how many of a token's pieces are intersected (the rarest), and what ends a text (no code point).
GRAM, RAREST, END = 3, 3, (1 << 21) - 1
#: Rows of a block on average; tokens, pieces or blocks up to which a lookup's are sent to all tasks (under 100 bytes each),
#: and pieces or blocks up to which they are named in the filter that Parquet sees.
BLOCK_ROWS, SENT, NAMED = 10_000, 200_000, 500
#: Code points that are cut into pieces at a time.
AT_ONCE = 1 << 18


def pieces(texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, piece) of the distinct pieces of each text, which ``end`` ENDs follow; in order."""
    size = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate([[0], np.cumsum(size + end)])
    points = np.full(at[-1] + GRAM - 1, END, np.uint64)
    points[np.arange(size.sum()) + np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    room = np.maximum(size + end - GRAM + 1, 0)
    row = np.repeat(np.arange(len(texts)), room)
    start = np.arange(room.sum()) + np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room)
    code = points[start] << np.uint64(42) | points[start + 1] << np.uint64(21) | points[start + 2]
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])) if len(row) else np.zeros(0, bool)
    return row[new], code[new].view(np.int64)


def _cut(rows: DataFrame, name: str, text: str, end: int) -> DataFrame:
    """(gram, name): the pieces of each text, each once for every value of ``name`` in a run of rows."""
    kind = rows.schema[name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names, first = batch.column(1).to_pylist(), batch.column(0).to_pylist(), 0
            while first < len(texts):
                last, held = first, 0
                while last < len(texts) and (last == first or held + len(texts[last]) <= AT_ONCE):
                    held, last = held + len(texts[last]), last + 1
                row, code = pieces(texts[first:last], end)
                known = sorted(set(names[first:last]))
                index = {n: k for k, n in enumerate(known)}
                place = np.array([index[n] for n in names[first:last]], np.int64)
                owner, order = place[row], np.lexsort((code, place[row]))
                owner, code = owner[order], code[order]
                new = np.append(True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1]))[: len(code)]
                yield pa.RecordBatch.from_arrays([pa.array(code[new]), pa.array(known, batch.column(0).type).take(pa.array(owner[new]))], names=["gram", name])
                first = last

    return rows.select(name, text).filter(F.col(text).isNotNull()).mapInArrow(run, f"gram long, {name} {kind}")


def write(rows: DataFrame, path: str, *, id: str, text: str) -> None:
    """Writes rows by block, and the index of their texts; null texts are left out.  An END follows each text, so any two characters begin a piece."""
    spark = rows.sparkSession
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.select(id, F.col(text).alias("text"), F.pmod(F.xxhash64(id), F.lit(blocks)).cast("int").alias("block")).filter("text is not null")
    dealt.repartitionByRange("block").sortWithinPartitions("block").write.mode("overwrite").parquet(f"{path}/rows")
    found = _cut(spark.read.parquet(f"{path}/rows"), "block", "text", 1).distinct()
    found.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n")).sort("gram").write.mode("overwrite").parquet(f"{path}/grams")


def candidates(spark: SparkSession, path: str, tokens: DataFrame) -> DataFrame:
    """(token, block) of the blocks that hold a token's rarest pieces; tokens of two characters are the beginnings of pieces."""
    postings, known = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/grams")
    long = _cut(tokens.filter(F.length("token") >= GRAM).withColumn("text", F.col("token")), "token", "text", 0)
    counted = long.join(known, "gram", "left").withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy("n", "gram")))  # a piece that no block has comes first, as null, and finds none
    chosen = counted.filter(F.col("rank") <= RAREST).withColumn("need", F.count("*").over(Window.partitionBy("token"))).select("token", "gram", "need")
    few = chosen.limit(SENT + 1).collect()
    of_long = postings
    if len(few) <= SENT:
        chosen = F.broadcast(spark.createDataFrame(few, chosen.schema))
        named = sorted({r["gram"] for r in few})
        of_long = postings.filter(F.col("gram").isin(named)) if len(named) <= NAMED else postings
    met = of_long.join(chosen, "gram").groupBy("token", "block").agg(F.count("*").alias("met"), F.first("need").alias("need")).filter("met = need").select("token", "block")
    short = _cut(tokens.filter(F.length("token") == GRAM - 1).withColumn("text", F.col("token")), "token", "text", 1).select("token", F.shiftright("gram", 21).alias("begin"))
    few = short.limit(SENT + 1).collect()
    if not few:
        return met
    begun = postings.withColumn("begin", F.shiftright("gram", 21)).join(F.broadcast(spark.createDataFrame(few, short.schema)) if len(few) <= SENT else short, "begin").select("token", "block").distinct()
    return met.unionByName(begun)


def _automaton(tokens: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for t in tokens:
        out.add_word(t, t)
    out.make_automaton()
    return out


def _scanned(spark: SparkSession, path: str, tokens: DataFrame, id: str) -> tuple[DataFrame, Callable]:
    """Rows of the candidate blocks, and what makes (id, tokens found) of their batches.

    Tokens are sent to all tasks if they are few; one automaton serves all blocks then, as a block that is no candidate
    of a token holds none.  Else pairs of token and block are dealt by block with the rows, and come before these.
    """
    rows, found = spark.read.parquet(f"{path}/rows").select(id, "text", "block"), candidates(spark, path, tokens)
    few = [r[0] for r in tokens.select("token").limit(SENT + 1).collect()]
    if len(few) <= SENT:
        known = spark.sparkContext.broadcast(sorted(few))
        blocks = found.select("block").distinct()
        own = [r[0] for r in blocks.limit(SENT + 1).collect()]
        if len(own) <= NAMED:
            rows = rows.filter(F.col("block").isin(sorted(own)))
        else:
            rows = rows.join(F.broadcast(spark.createDataFrame([(b,) for b in own], "block int")) if len(own) <= SENT else blocks, "block", "left_semi").select(id, "text", "block")

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            made = _automaton(known.value) if known.value else None
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if made:
                        yield i, {t for _, t in made.iter(text)}

        return rows, hits
    both = found.select(F.lit(None).cast(rows.schema[id].dataType).alias(id), F.col("token").alias("text"), "block").withColumn("kind", F.lit(0))
    dealt = both.unionByName(rows.withColumn("kind", F.lit(1))).repartition("block").sortWithinPartitions("block", "kind")

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, wanted, made = None, [], None
        for batch in batches:
            for i, text, block, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    now, wanted, made = block, [], None
                if kind == 0:
                    wanted.append(text)
                elif wanted:
                    made = made or _automaton(wanted)
                    yield i, {t for _, t in made.iter(text)}

    return dealt, hits


def containing(spark: SparkSession, path: str, tokens: DataFrame, *, id: str) -> DataFrame:
    """(token, id): every row whose text contains a token; tokens: distinct, of two characters or more."""
    rows, hits = _scanned(spark, path, tokens, id)
    kind = rows.schema[id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((t, i) for i, found in hits(batches) for t in found)
        while part := list(islice(pairs, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in part], pa.string()), pa.array([i for _, i in part], to_arrow_type(kind))], names=["token", id])

    return rows.mapInArrow(run, f"token string, {id} {kind.simpleString()}")


def counts(spark: SparkSession, path: str, tokens: DataFrame, *, id: str) -> DataFrame:
    """(token, n, first): how many rows contain each token that any does, and the least id of them; tasks count before anything moves."""
    rows, hits = _scanned(spark, path, tokens, id)
    kind = rows.schema[id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[str, list] = {}
        for i, found in hits(batches):
            for t in found:
                if (own := told.get(t)) is None:
                    told[t] = [1, i]
                else:
                    own[0] += 1
                    own[1] = min(own[1], i)
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(list(told), pa.string()), pa.array([v[0] for v in told.values()], pa.int64()), pa.array([v[1] for v in told.values()], to_arrow_type(kind))], names=["token", "n", "first"])

    return rows.mapInArrow(run, f"token string, n long, first {kind.simpleString()}").groupBy("token").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
