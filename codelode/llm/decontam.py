"""Benchmark decontamination: pigeonhole pieces and Myers' bit-parallel distance.

Texts are compared as words (runs of ASCII letters in lower case, digits and
non-ASCII characters), so case, punctuation and spacing do not hide a leak.  An
item of m words may differ from a passage by ``k = floor(rate * m)`` word edits
(insertions, deletions, replacements).  It is split into k + 1 pieces of nearly
equal length, one of which any such passage must hold exactly.  Whole pieces are
looked up, by their hash, at every position of every document.  Of the items with a
piece there, those with fewer than m - k of their words around the place cannot
match; the others are verified with Myers' algorithm, whose bit vectors have a bit for
each word of the item.

Items are taken in blocks of bounded size, one pass over the documents for each
block; only the last block's is open at a time, and an item is never compared with a
document that shares no piece with it.

Edge cases: null or empty texts hold no leak; items that are null or without a word,
or shorter than ``min_words``, are not searched (``search`` takes all; ``clean`` passes
over items under ``MIN_WORDS``, which do not identify a benchmark); with a rate of 1 or
more every item would be found everywhere, so rates are below 1; very long texts and
items are compared whole; of equally good passages the first counts; repeated documents
and items are reported row by row (an item table's equal rows once); empty tables give no
rows.  Only ids and texts are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from codelode.llm import _kernel as K
from codelode.llm._store import settle

#: Word edits allowed for each word of an item.
RATE = 0.1
#: Words of the shortest item that costs a document its place.
MIN_WORDS = 5
#: Words of a piece that are looked up, so that there are few lengths at any rate (pieces have about 1 / rate).
KEY_WORDS = 32
#: Words of the items of one block, at most (a longer item is a block of its own).
BLOCK_WORDS = 1_000_000


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents, and the words before each document."""
    lower = K.LOWER[buf]
    starts, ends, woffs = K.words(lower, offs, K.NOT_WORD)
    return (K.span_hash(K.prefix_hash(lower), starts, ends) if len(starts) else np.empty(0, np.uint64)), woffs


def myers(pattern: list[int], text: list[int], anchored: bool = False) -> list[int]:
    """Edit distances of the pattern and the best passage that ends after each word of the text.

    anchored: the passage begins where the text does.
    """
    m = len(pattern)
    peq: dict[int, int] = {}
    for k, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << k
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = mask, 0, m, []
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1 | anchored) & mask
        mh = mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        out.append(score)
    return out


@dataclass(frozen=True)
class Block:
    """Items of a block: their ids, words and edit budgets; and for each length of pieces their hashes, sorted, with the items they are from and where.

    flat and bounds: the distinct words of each item, one item after another.
    """

    ids: list
    items: list[np.ndarray]
    budgets: list[int]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    flat: np.ndarray
    bounds: np.ndarray

    def _possible(self, owners: np.ndarray, region: np.ndarray) -> np.ndarray:
        """Whether so many of each item's different words stand in the region that its budget allows a match."""
        n = self.bounds[owners + 1] - self.bounds[owners]
        stop = np.cumsum(n)
        words = self.flat[np.repeat(self.bounds[owners] - (stop - n), n) + np.arange(stop[-1])]
        known = np.unique(region)
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        missing = np.add.reduceat((known[at] != words).astype(np.int64), stop - n)
        return missing <= np.array([self.budgets[k] for k in owners.tolist()])

    def leaks(self, words: np.ndarray, places: list[tuple[np.ndarray, np.ndarray, int]]) -> list[tuple[int, int, int, int]]:
        """(item, distance, first word, word after the last) of the best passage for each item; places: (items, offsets, word)."""
        spots: dict[int, set[int]] = {}
        for owners, offsets, at in places:
            if len(owners) > 8:
                sizes = np.array([len(self.items[k]) + self.budgets[k] for k in owners.tolist()])
                reach = int((sizes + offsets).max())
                ok = self._possible(owners, words[max(0, at - reach) : at + reach])
                owners, offsets = owners[ok], offsets[ok]
            for item, offset in zip(owners.tolist(), offsets.tolist(), strict=True):
                spots.setdefault(item, set()).add(at - offset)
        out = []
        for item, diagonals in spots.items():
            own, k = self.items[item], self.budgets[item]
            exact = next((d for d in sorted(diagonals) if d >= 0 and np.array_equal(words[d : d + len(own)], own)), None)
            if exact is not None:
                out.append((item, 0, exact, exact + len(own)))
                continue
            best, pattern = None, own.tolist()
            for a, b in _regions(sorted(diagonals), len(own), k, len(words)):
                region = words[a:b].tolist()
                scores = myers(pattern, region)
                least = min(scores, default=k + 1)
                if least <= k and (best is None or least < best[0]):
                    end = scores.index(least) + 1
                    back = myers(pattern[::-1], region[:end][::-1], anchored=True)
                    best = (least, a + end - (back.index(least) + 1), a + end)
            if best:
                out.append((item, *best))
        return sorted(out)


def _regions(diagonals: list[int], m: int, k: int, n: int) -> Iterator[tuple[int, int]]:
    """Surroundings of the places where an item could begin; those that overlap are one."""
    own: list[int] | None = None
    for d in diagonals:
        a, b = max(0, d - k), min(n, d + m + k)
        if own and a <= own[1]:
            own[1] = max(own[1], b)
            continue
        if own:
            yield own[0], own[1]
        own = [a, b]
    if own:
        yield own[0], own[1]


def compile_block(ids: list, texts: list[str], rate: float, min_words: int) -> Block | None:
    if not 0 <= rate < 1:
        raise ValueError("the rate must be at least 0 and below 1")
    kept, items, budgets, hashes = [], [], [], []
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for _, _, buf, offs in K.chunks(pa.array(texts, pa.string())):
        h, w = word_hashes(buf, offs)
        hashes += [h[a:b] for a, b in zip(w[:-1], w[1:], strict=True)]
    for k, own in enumerate(hashes):
        m = len(own)
        if m < max(min_words, 1):
            continue
        budget, sums = int(rate * m), K.gram_sums(own)
        for p in range(budget + 1):
            at, n = m * p // (budget + 1), m * (p + 1) // (budget + 1) - m * p // (budget + 1)
            n = min(n, KEY_WORDS)
            by_length.setdefault(n, []).append((int(K.span_hash(sums, np.array([at]), np.array([at + n]))[0]), len(items), at))
        kept.append(ids[k])
        items.append(own)
        budgets.append(budget)
    if not items:
        return None
    pieces = {}
    for n, own in by_length.items():
        seeds, owner, offset = np.array([x[0] for x in own], np.uint64), np.array([x[1] for x in own]), np.array([x[2] for x in own])
        order = np.argsort(seeds, kind="stable")
        likely = np.zeros(1 << 20, bool)
        likely[seeds >> np.uint64(44)] = True
        pieces[n] = (seeds[order], owner[order], offset[order], np.packbits(likely))
    distinct = [np.unique(x) for x in items]
    return Block(kept, items, budgets, pieces, np.concatenate(distinct), np.concatenate([[0], np.cumsum([len(x) for x in distinct])]))


def find(column: pa.Array, block: Block) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
    """(row, leak) of all rows of a column of texts."""
    likely = {n: np.unpackbits(own[3]).view(bool) for n, own in block.pieces.items()}
    for first, _, buf, offs in K.chunks(column):
        words, woffs = word_hashes(buf, offs)
        sums = K.gram_sums(words)
        by_row: dict[int, list] = {}
        for n, (seeds, owner, offset, _) in block.pieces.items():
            own = K.long_grams(sums, n)
            at = np.flatnonzero(likely[n][own >> np.uint64(44)])
            at = at[K.inside(woffs, n, len(own))[at]]
            lo, hi = np.searchsorted(seeds, own[at]), np.searchsorted(seeds, own[at], "right")
            hit = hi > lo
            at, lo, hi = at[hit], lo[hit], hi[hit]
            rows = np.searchsorted(woffs, at, "right") - 1
            for row, p, a, b in zip(rows.tolist(), (at - woffs[rows]).tolist(), lo.tolist(), hi.tolist(), strict=True):
                by_row.setdefault(row, []).append((owner[a:b], offset[a:b], p))
        for row in sorted(by_row):
            for leak in block.leaks(words[int(woffs[row]) : int(woffs[row + 1])], by_row[row]):
                yield first + row, leak


def blocks(benchmark: DataFrame, rate: float, min_words: int, block_words: int) -> Iterator[Block]:
    """The items in blocks of bounded size, read one partition at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").distinct().toLocalIterator():
        n = len(r["text"].split()) + 1
        if ids and size + n > block_words:
            if block := compile_block(ids, texts, rate, min_words):
                yield block
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += n
    if ids and (block := compile_block(ids, texts, rate, min_words)):
        yield block


def _passes(docs: DataFrame, found: Iterator[Block], one: Callable[[DataFrame, Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """What ``one`` makes of each block; all but the last are settled, and their blocks taken back from the executors."""
    before = None
    for block in found:
        if before is not None:
            yield settle(one(docs, before))
            before.unpersist()
        before = docs.sparkSession.sparkContext.broadcast(block)
    if before is not None:
        yield one(docs, before)


_SCHEMA = "doc_id long, item_id long, distance long, item_words long, first_word long, end_word long"


def search(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, min_words: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and item that leaks into it, with the best passage (words from 0, end exclusive)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def one(docs: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[row], b.ids[i], d, len(b.items[i]), s, e) for row, (i, d, s, e) in find(batch.column(1), b)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

        return docs.mapInArrow(K.frugal(run), _SCHEMA)

    found = list(_passes(docs, blocks(benchmark, rate, min_words, block_words), one))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents into which no item leaks, with all their columns and without a shuffle."""
    at = docs.columns.index("text")
    before = None
    for block in blocks(benchmark, rate, min_words, block_words):
        if before is not None:  # what earlier blocks left, settled, so that one block is with the executors at a time
            docs = settle(docs)
            before.unpersist()
        before = shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaky = np.zeros(batch.num_rows, bool)
                for row, _ in find(batch.column(at), shared.value):
                    leaky[row] = True
                yield batch.filter(pa.array(~leaky))

        docs = docs.mapInArrow(K.frugal(run), docs.schema)
    return docs
