"""Suffix-array dedup of exact substrings by prefix-free parsing.

Every byte that lies in a string of ``LENGTH`` bytes which also starts anywhere else in
the corpus is removed.

Dealing out.  A rolling hash of ``TRIGGER`` bytes is taken at each position.  The least hash
among the ``REACH`` positions from a start is the start's trigger; neighbouring starts with
the same trigger form a piece, from the first of them to ``LENGTH`` bytes past the last.
Triggers depend on content alone, so equal strings lie in pieces with equal triggers.
A first pass counts the ``KEY`` bytes from each trigger; those seen once cannot be in a
repeat, the others are marked in a bitmap, which grows with the input up to ``MOST_BITS``
(a mark too many costs time, not correctness).  A second pass sends the marked pieces to the
part of their trigger.  A task sends equal pieces once, and tells that they are repeated;
places of such pieces are merged and go straight to their documents.  A trigger of more pieces
than a task can hold (a passage in many documents, each with words of its own around it) is
hot: of its pieces each start goes alone, without bytes, to the part of its own string's
fingerprint, so only equal strings meet.

Order.  The pieces of a part are a small corpus, whose suffix order is built by prefix-free
parsing:

1. Hashes of ``LOCAL`` bytes that are 0 modulo ``SPARSE`` trigger short phrases, which
   overlap by the trigger.  No phrase suffix longer than a trigger is a prefix of another.
2. The distinct phrases are the dictionary; its suffix array (as ranks) is built by prefix
   doubling over bytes.
3. The parse is the sequence of the phrases' ranks; its suffix array is built likewise.
4. A position of the corpus is a suffix of a phrase, followed by a suffix of the parse.
   The ranks of both, combined, put all positions in order of their text.

Neighbours in that order that agree in ``LENGTH`` bytes (compared by fingerprint), and all of
a piece that occurs twice, are the repeats.  As intervals they go back to their
documents, whose unions of them are removed.  Only the first ``LENGTH`` bytes of a suffix
matter, so doubling stops there.

Fingerprints have 64 bits.  Edge cases: a null text is an empty one; texts below LENGTH
bytes lose nothing; very long texts are parsed in segments, and periodic ones make one
piece for each phase of their period; rows with equal doc_id and text are copies of each
other like any others (both lose what they share), and their equal intervals are merged;
null ids are ordinary values; an empty table gives no rows.  Only the id and the text are
read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codelode.llm import _kernel as K

#: Bytes of a repeated string; starts that share a trigger at most; bytes that are counted from a trigger; bytes of the rolling hash.
LENGTH, REACH, TRIGGER = 200, 140, 16
KEY = LENGTH - REACH + 1
#: Bits of the bitmap of triggers seen twice, which every task gets: as many as bytes of text, from 1 MB to 128 MB in all.
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 30
#: Bytes of text for each slice of the count and each task of the order, of pieces for each part, and of a segment of a long text.
SLICE_BYTES, TASK_BYTES, PART_BYTES, SEGMENT = 64 << 20, 8 << 20, 1 << 20, 1 << 21
#: Triggers that can be hot at most (8 bytes each, sent to all tasks); a hot one has more pieces than that allows, and than a task's bytes hold.
HOT_KEYS, HOT_BYTES = 10_000_000, TASK_BYTES
#: Bytes of the local triggers of the parse, and the share of hashes that trigger.
LOCAL, SPARSE = 8, 64
#: Pieces that a task remembers as sent; beyond it the memory starts anew, and some are sent once more.
REMEMBERED = 2_000_000


def pieces(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each piece, its trigger's key, and the prefix hash of the bytes."""
    sums = K.prefix_hash(buf)
    n = len(buf) - TRIGGER + 1
    room = np.maximum(np.diff(offs) - LENGTH + 1, 0)
    total = int(room.sum())
    if not total:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), sums
    _, inv = K.powers(len(sums))
    h = (sums[TRIGGER:] - sums[:-TRIGGER]) * inv[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h = h & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)  # equal hashes: the first position counts
    blocks = -(-n // REACH) + 1
    padded = np.full(blocks * REACH, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    table = padded.reshape(blocks, REACH)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(ahead) - REACH + 1], ahead[REACH - 1 :])
    starts = np.repeat(offs[:-1] - (np.cumsum(room) - room), room) + np.arange(total)
    trigger = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], total) - 1
    return starts[at], starts[last], K.span_hash(sums, trigger[at], trigger[at] + KEY), sums


def _parse(column: pa.Array) -> Iterator[tuple]:
    """(first row, bytes, offsets, place of the first byte in its text, *pieces) of runs of rows; a long text comes in segments."""
    for at, _, buf, offs in K.chunks(column):
        if len(offs) > 2 or len(buf) <= SEGMENT:
            yield at, buf, offs, 0, *pieces(buf, offs)
            continue
        for base in range(0, len(buf) - LENGTH + 1, SEGMENT):
            part = buf[base : base + SEGMENT + LENGTH - 1]
            ends = np.array([0, len(part)])
            yield at, part, ends, base, *pieces(part, ends)


def _count(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[pa.RecordBatch]:
    """Keys of a batch by slice: all of them, and those that the batch has twice, with how often."""
    shift = np.uint64(64 - (slices.bit_length() - 1))
    for batch in batches:
        keys = [p[6] for p in _parse(batch.column(0))]
        if not keys:
            continue
        keys, count = np.unique(np.concatenate(keys), return_counts=True)
        at = np.searchsorted(keys >> shift if slices > 1 else np.zeros(len(keys), np.uint64), np.arange(slices + 1))
        rows = [(k, keys[a:b].tobytes(), keys[a:b][count[a:b] > 1].tobytes(), (count[a:b][count[a:b] > 1] - 1).astype(np.uint32).tobytes()) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["slice", "keys", "twice", "more"])


def _mark(batches: Iterator[pa.RecordBatch], slices: int, bits: int, hot: int) -> Iterator[pa.RecordBatch]:
    """The bitmap of each slice's keys that occur twice, and the keys that occur ``hot`` times or more."""
    by_slice: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for batch in batches:
        for k, keys, twice, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by_slice.setdefault(k, []).append((np.frombuffer(keys, np.uint64), np.frombuffer(twice, np.uint64), np.frombuffer(more, np.uint32)))
    width = max(8, bits // slices)
    for k, parts in by_slice.items():
        keys = np.sort(np.concatenate([p[0] for p in parts]))
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, count = keys[at], np.diff(np.append(at, len(keys)))
        for _, twice, more in parts:
            count[np.searchsorted(keys, twice)] += more
        marks = np.zeros(width, bool)
        at = (keys[count > 1] >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)
        first = k * bits // slices // 8 * 8
        marks[at - first] = True
        yield pa.RecordBatch.from_arrays([pa.array([first // 8], pa.int32()), pa.array([zlib.compress(np.packbits(marks, bitorder="little").tobytes(), 1)], pa.binary()), pa.array([keys[count >= hot].tobytes()], pa.binary())], names=["first", "bits", "hot"])


def repeated_triggers(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitmap of keys that occur twice in the corpus, as bytes, and the hot keys in order."""
    slices, bits = 1, LEAST_BITS
    while slices * SLICE_BYTES < total:
        slices *= 2
    while bits < min(total, MOST_BITS):
        bits *= 2
    hot = max(2, HOT_BYTES // (LENGTH + REACH), total // REACH // HOT_KEYS)
    counted = docs.select("text").mapInArrow(K.frugal(lambda it: _count(it, slices)), "slice int, keys binary, twice binary, more binary")
    out, keys = np.zeros(bits // 8, np.uint8), [np.empty(0, np.uint64)]
    for r in counted.repartition(slices, "slice").mapInArrow(K.frugal(lambda it: _mark(it, slices, bits, hot)), "first int, bits binary, hot binary").toLocalIterator():
        own = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
        out[r["first"] : r["first"] + len(own)] |= own
        keys.append(np.frombuffer(r["hot"], np.uint64))
    return out, np.sort(np.concatenate(keys))


_GATHERED = "key long, content long, piece binary, twice boolean, doc_id long, text_hash long, first long, last long"


def _merged(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of starts by row, those that touch made one."""
    order = np.lexsort((first, row))
    row, first, last = row[order], first[order], last[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)  # pieces of a text do not overlap
    at = np.flatnonzero(new)
    return row[at], first[at], last[np.append(at[1:], len(row)) - 1] if len(row) else last


def _gather(batches: Iterator[pa.RecordBatch], marks) -> Iterator[pa.RecordBatch]:
    """Marked pieces (of hot triggers: each start): a new one with its bytes and place; if it is repeated in the task, its bytes once, and all places without."""
    marks, hot = marks.value
    shift = np.uint64(64 - ((len(marks) * 8).bit_length() - 1))
    names = [x.split()[0] for x in _GATHERED.split(", ")]
    sent, told = np.empty(0, np.uint64), np.empty(0, bool)
    for batch in batches:
        found, spans, buffers = [], [], []
        for at, buf, offs, base, first, last, key, sums in _parse(batch.column(2)):
            bit = (key >> shift).astype(np.int64)
            ok = np.flatnonzero(marks[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            if not len(ok):
                continue
            first, last, key = first[ok], last[ok], key[ok]
            end = last + LENGTH
            if len(hot):
                apart = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                n = last[apart] - first[apart] + 1
                starts = np.repeat(first[apart] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                first, last, key = (np.concatenate([c[~apart], x]) for c, x in ((first, starts), (last, starts), (key, K.span_hash(sums, starts, starts + LENGTH))))
                end = np.concatenate([end[~apart], starts])  # these are sent without bytes
            row = np.searchsorted(offs, first, "right") - 1
            found.append((key, K.span_hash(sums, first, last + LENGTH), at + row, base + first - offs[row], base + last - offs[row]))
            spans.append((np.full(len(first), len(buffers)), first, end))
            buffers.append(buf)
        if not found:
            continue
        key, content, row, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
        buffer, begin, end = (np.concatenate(c) for c in zip(*spans, strict=True))
        distinct, index, back, count = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
        place = np.minimum(np.searchsorted(sent, distinct), max(len(sent) - 1, 0))
        old = sent[place] == distinct if len(sent) else np.zeros(len(distinct), bool)
        repeated = old | (count > 1)
        untold = old.copy()
        untold[old] = ~told[place[old]]
        told[place[old]] = True
        once = index[~repeated]
        shown, notice = index[repeated & ~old], index[untold]
        # What is unique so far: bytes and place in one row.  Repeats: their bytes, or a notice that what was sent is one, and places.
        for at, with_bytes, with_place, twice in ((once, True, True, False), (shown, True, False, True), (notice, False, False, True)):
            for k in range(0, len(at), 20_000):
                own = at[k : k + 20_000]
                n = len(own)
                where = [batch.column(0).take(pa.array(row[own])), batch.column(1).take(pa.array(row[own])), pa.array(first[own]), pa.array(last[own])] if with_place else [pa.nulls(n, pa.int64())] * 4
                what = pa.array([buffers[b][s:e].tobytes() for b, s, e in zip(buffer[own].tolist(), begin[own].tolist(), end[own].tolist(), strict=True)], pa.binary()) if with_bytes else pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key[own].view(np.int64)), pa.array(content[own].view(np.int64)), what, pa.array(np.full(n, twice)), *where], names=names)
        known = repeated[back]
        at, first, last = _merged(row[known], first[known], last[known])
        for k in range(0, len(at), 50_000):
            own = slice(k, k + 50_000)
            n = len(at[own])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.ones(n, bool)), batch.column(0).take(pa.array(at[own])), batch.column(1).take(pa.array(at[own])), pa.array(first[own]), pa.array(last[own])], names=names)
        if len(sent) > REMEMBERED:
            sent, told = np.empty(0, np.uint64), np.empty(0, bool)
        else:
            place = np.searchsorted(sent, distinct[~old])
            sent, told = np.insert(sent, place, distinct[~old]), np.insert(told, place, repeated[~old])


# The order of a part --------------------------------------------------------


def suffix_ranks(keys: np.ndarray, depth: int, ends: np.ndarray, limit: int) -> np.ndarray:
    """Ranks of the suffixes of sequences by prefix doubling; equal ranks agree in ``limit`` elements or to the end.

    keys: order by the first ``depth`` elements; ends: where the sequence of each position ends.
    """
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))  # a group's rank is its first place
    open_ = order[~(new & np.append(new[1:], True))]  # in groups of more than one
    while len(open_) and depth < limit:
        after = open_ + depth
        inside = after < ends[open_]
        second = np.where(inside, rank[np.minimum(after, len(rank) - 1)] + 1, 0)
        own = np.argsort(rank[open_] * np.int64(len(keys) + 1) + second)
        open_, second = open_[own], second[own]
        first = rank[open_]
        group, part = np.ones(len(open_), bool), np.ones(len(open_), bool)
        group[1:] = first[1:] != first[:-1]
        part[1:] = group[1:] | (second[1:] != second[:-1])
        place = np.arange(len(open_))
        rank[open_] = first + np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        open_ = open_[~(part & np.append(part[1:], True)) & (second > 0)]  # what has ended in both is equal for good
        depth *= 2
    return rank


def corpus_order(buf: np.ndarray, offs: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions with LENGTH bytes before their text's end, and their order by these bytes; equal ones are neighbours."""
    n, (_, inv) = len(buf), K.powers(len(sums))
    text_end = np.repeat(offs[1:], np.diff(offs))
    h = (sums[LOCAL:] - sums[:-LOCAL]) * inv[: max(n - LOCAL + 1, 0)]
    h = K.mix(h)
    cut = np.zeros(n, bool)
    cut[: len(h)] = (h % np.uint64(SPARSE) == 0) & (np.arange(len(h)) + LOCAL <= text_end[: len(h)])
    cut[offs[:-1][np.diff(offs) > 0]] = True
    begin = np.flatnonzero(cut)
    end = np.minimum(np.append(begin[1:], n) + LOCAL, text_end[begin])
    # The dictionary, its suffixes' ranks, and with them the phrases' ranks.
    _, index, phrase = np.unique(K.span_hash(sums, begin, end), return_index=True, return_inverse=True)
    size = (end - begin)[index]
    at = np.concatenate([[0], np.cumsum(size)])
    dictionary = buf[np.repeat(begin[index] - at[:-1], size) + np.arange(at[-1])]
    ends = np.repeat(at[1:], size)
    keys, values = np.zeros(len(dictionary), np.uint64), np.append(dictionary.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64))
    for k in range(7):  # seven bytes of nine bits, 0 past the phrase's end
        keys = keys << np.uint64(9) | np.where(np.arange(len(dictionary)) + k < ends, values[k : len(dictionary) + k], np.uint64(0))
    suffix = suffix_ranks(keys, 7, ends, LENGTH)
    # The parse and its suffixes' ranks; 0 stands for its end.
    parse = suffix[at[:-1]][phrase]
    last = np.append(begin[1:], n) == text_end[begin]
    closes = np.flatnonzero(last) + 1
    parse_end = closes[np.searchsorted(closes, np.arange(len(begin)), "right")]
    after = np.append(suffix_ranks(parse, 1, parse_end, LENGTH) + 1, 0)
    follows = np.where(last, 0, after[1:])
    room = np.maximum(np.diff(offs) - LENGTH + 1, 0)
    starts = np.repeat(offs[:-1] - (np.cumsum(room) - room), room) + np.arange(room.sum())
    own = np.searchsorted(begin, starts, "right") - 1
    of_suffix = suffix[at[:-1][phrase[own]] + starts - begin[own]]
    return starts, np.argsort(of_suffix * np.int64(len(begin) + 1) + follows[own])


def _runs_of(words: pa.Array, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, first, last) of the maximal runs of repeated starts, by piece; known: pieces that occur twice."""
    at, _, buf, offs = next(K.chunks(words, 1 << 40))
    sums = K.prefix_hash(buf)
    starts, order = corpus_order(buf, offs, sums)
    prints = K.span_hash(sums, starts, starts + LENGTH)[order]
    same = np.zeros(len(prints) + 1, bool)
    np.equal(prints[1:], prints[:-1], out=same[1:-1])
    owner = np.searchsorted(offs, starts, "right") - 1
    dup = np.zeros(len(prints), bool)
    dup[order] = same[1:] | same[:-1]
    dup |= known[owner]  # any other suffix that agrees with these is their neighbour already
    edge = np.ones(len(dup) + 1, bool)
    edge[1:-1] = (dup[1:] != dup[:-1]) | (owner[1:] != owner[:-1])
    cut = np.flatnonzero(edge)
    runs = np.flatnonzero(dup[cut[:-1]])
    a, b = cut[:-1][runs], cut[1:][runs] - 1
    return owner[a], starts[a] - offs[owner[a]], starts[b] - offs[owner[b]]


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of repeated starts of the places of a task's pieces; places known to be repeats pass as they are.

    The pieces are put in order part by part, a trigger's together.
    """
    texts: dict[int, tuple[int, bytes]] = {}
    got: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        yield batch.filter(batch.column(1).is_null()).select([4, 5, 6, 7])
        batch = batch.filter(batch.column(1).is_valid())
        key, content, shipped = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(shipped).tolist():
            if content[k] not in texts:  # other copies of the bytes are dropped as they come
                texts[content[k]] = (int(key[k]), batch.column(2)[k].as_py())
        got.append((content, batch.column(3).to_numpy(zero_copy_only=False), shipped, batch.select([4, 5, 6, 7])))
    if not texts:
        return
    content, twice, shipped = (np.concatenate([g[k] for g in got]) for k in range(3))
    places = pa.Table.from_batches([g[3] for g in got]).combine_chunks()
    del got
    distinct, back = np.unique(content, return_inverse=True)
    known = np.bincount(back, shipped, len(distinct)) > 1
    np.logical_or.at(known, back, twice)
    size = np.array([len(texts[int(c)][1]) for c in distinct])
    part = (K.mix(np.array([texts[int(c)][0] for c in distinct], np.int64).view(np.uint64)) % np.uint64(max(1, -(-int(size.sum()) // PART_BYTES)))).astype(np.int64)
    alone = np.flatnonzero(known & (size == 0))  # starts of hot triggers: equal ones have met here
    found = [(alone, np.zeros(len(alone), np.int64), np.zeros(len(alone), np.int64))]
    for own in np.split(np.argsort(part, kind="stable"), np.cumsum(np.bincount(part))[:-1]):
        own = own[size[own] > 0]
        if len(own):
            piece, first, last = _runs_of(pa.array([texts.pop(int(distinct[k]))[1] for k in own], pa.binary()), known[own])
            found.append((own[piece], first, last))
    run_owner, run_from, run_to = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(run_owner, kind="stable")
    run_owner, run_from, run_to = run_owner[order], run_from[order], run_to[order]
    by_owner = np.searchsorted(run_owner, np.arange(len(distinct) + 1))
    # Places whose repeats are not known from their own task.
    rows = np.flatnonzero(~twice)
    n = by_owner[back[rows] + 1] - by_owner[back[rows]]
    rows, n = rows[n > 0], n[n > 0]
    run = np.repeat(by_owner[back[rows]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    own = places.take(pa.array(np.repeat(rows, n))).combine_chunks()
    for b in pa.table({"doc_id": own["doc_id"], "text_hash": own["text_hash"], "first": own["first"].to_numpy().astype(np.int64) + run_from[run], "last": own["first"].to_numpy().astype(np.int64) + run_to[run]}).to_batches(50_000):
        yield b


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, first, last): intervals of starts of repeated strings; docs: doc_id, text_hash and text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marks = docs.sparkSession.sparkContext.broadcast(repeated_triggers(docs, total))
    gathered = docs.mapInArrow(K.frugal(lambda it: _gather(it, marks)), _GATHERED)
    # Pieces meet by trigger; places that need no more comparison are spread evenly.
    meet = F.when(F.col("content").isNotNull(), F.col("key")).otherwise(F.xxhash64("doc_id", "first"))
    return gathered.repartition(max(1, -(-total // TASK_BYTES)), meet).mapInArrow(K.frugal(_ordered), "doc_id long, text_hash long, first long, last long")


_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _union(firsts: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of the bytes of strings that start in these intervals."""
    order = np.argsort(firsts, kind="stable")
    start, end = firsts[order], np.maximum.accumulate(lasts[order] + LENGTH)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1]


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    spans = batch.column(column)
    values = spans.values
    firsts, lasts = (values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    offs = spans.offsets.to_numpy()
    for k in range(batch.num_rows):
        a, b = int(offs[k]), int(offs[k + 1])
        yield _union(firsts[a:b], lasts[a:b]) if b > a and spans[k].is_valid else (np.empty(0, np.int64), np.empty(0, np.int64))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        runs, rows = _runs(batch, 2), []
        for _, _, buf, offs in K.chunks(batch.column(1)):
            raw = buf.tobytes()
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                starts, ends = next(runs)
                h, at = hashlib.sha256(), a
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    h.update(raw[at : a + s])
                    at = a + e
                h.update(raw[at:b])
                rows.append((b - a, int((ends - starts).sum()), len(starts), h.hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text and spans (null: none) of all documents."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    spans = repeated_starts(keyed).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"), "spans")
    return keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["of"]) & (keyed["text_hash"] == spans["hash"]), "left").select("doc_id", "text", "spans")


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document: its bytes, those removed, the maximal runs of these, and the digest of the rest."""
    return _marked(docs).mapInArrow(K.frugal(_digest), _SCHEMA)


def clean(docs: DataFrame) -> DataFrame:
    """doc_id and the text without the removed bytes (a character that is cut becomes U+FFFD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = _runs(batch, 2), []
            for _, _, buf, offs in K.chunks(batch.column(1)):
                raw = buf.tobytes()
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    parts, at = [], a
                    for s, e in zip(*(x.tolist() for x in next(runs)), strict=True):
                        parts.append(raw[at : a + s])
                        at = a + e
                    texts.append(b"".join([*parts, raw[at:b]]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _marked(docs).mapInArrow(K.frugal(run), "doc_id long, text string")
