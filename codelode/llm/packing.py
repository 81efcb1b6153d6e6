"""Packing: non-negative least squares over shallow length combinations.

Documents become tokens and an end mark.  Full windows of a long document are
sequences of their own; what remains (under a window) is packed, in levels of
windows of 4, 8, ... up to ``WINDOW`` tokens.  A remainder of a quarter of a
level's window or more, and less than half, belongs to that level (to the last all
from a quarter on, to the first all that are shorter).  At each level

1. the lengths, with those of the units that the level below filled, are counted in
   ``CELLS`` steps, all combinations of at most ``DEPTH`` lengths that fill the window
   are enumerated, and non-negative least squares finds how often to repeat each
   so that the histogram is used up;
2. the counts are rounded down and carried out, then up, the largest fractions
   first, as long as there are such lengths;
3. what is filled is a unit of the next level (a sequence at the last), and what is
   left goes there as it is.

So short documents are planned like long ones.  What the last level leaves is packed
greedily, one sequence after another, and the document that crosses a window's end
is cut there at a multiple of ``STEP``.

Tokens are made once.  The first pass keeps, for each document, the checksums of
its full windows and of each ``STEP`` tokens of the remainder, about a hundred
bytes; checksums of cut pieces are combined from those.  Documents are dealt into
groups of about ``GROUP`` by a hash that takes in their place in a batch, and each group is packed
by itself, so neither the driver nor a task ever sees more than a group's lengths.

Edge cases: a null or empty text is the end mark alone; very long texts are tokenized
whole, a task's memory growing with the longest; repeated rows are packed row by row
and spread over all groups; ids may be null or equal; of equal lengths the one with the
least id is taken last; an empty table gives no rows; only the id and the text are read,
so further columns cannot clash.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codelode.llm import _kernel as K

WINDOW, STEP, DEPTH, CELLS, LEAST_WINDOW = 4096, 16, 3, 256, 4
#: Documents of a group; more groups make no other difference than one part-filled sequence each.
GROUP = 50_000
#: The id that ends each document.
END = 2
#: Words that a worker's memory of tokens holds; beyond it the memory starts anew.
REMEMBERED = 600_000


# Tokens ---------------------------------------------------------------------

_OTHER = 4
#: White space, ASCII letters, digits, punctuation but the apostrophe, and all else.  The tokenizer always
#: parts two different ones of the middle three, so the text between such places can be tokenized by itself.
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
_CLASS[0x27] = _OTHER
_CLASS[K.SPACE] = 0


#: The normaliser and splitter for which that holds; texts of other tokenizers are encoded whole.
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _parts_at_classes(tokenizer) -> bool:
    """Whether a tokenizer folds case and splits texts in the way that the memory of pieces relies on."""
    known = json.loads(tokenizer.to_str())
    splitter = known["pre_tokenizer"] or {}
    first = (splitter.get("pretokenizers") or [splitter])[0]
    return known["normalizer"] == _NORMALISER and first.get("type") == "Split" and first.get("pattern") == {"Regex": _SPLIT} and first.get("behavior") == "Removed" and first.get("invert") is True


class Tokens:
    """A tokenizer with a memory of the ids of each piece of text between safe places."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_pieces = _parts_at_classes(self.tokenizer)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.ids = np.array([END], np.uint32)
        self.ends = np.array([0, 1], np.int64)

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        """Tokenizes unknown pieces, many in one text, and remembers them."""
        ids, counts = [self.ids], []
        for k in range(0, len(pieces), 256):
            some = [p.decode("utf-8", "replace") for p in pieces[k : k + 256]]
            place = np.cumsum([0] + [len(s) + 1 for s in some])
            enc = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids.append(np.array(enc.ids, np.uint32))
            owner = np.searchsorted(place, np.array(enc.offsets, np.int64).reshape(-1, 2)[:, 0], "right") - 1
            counts.append(np.bincount(owner, minlength=len(place) - 1)[: len(place) - 1])
        new = len(self.ends) - 1 + np.arange(len(h))
        self.ids = np.concatenate(ids)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])
        place = np.searchsorted(self.known, h)  # both are sorted
        self.known, self.at = np.insert(self.known, place, h), np.insert(self.at, place, new)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids with END after each document, offsets) of runs of rows."""
        for first, last, buf, offs in K.chunks(column, 1 << 19):
            if not self.by_pieces:
                texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
                ids = [np.array([*e.ids, END], np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
                yield first, last, np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                continue
            lower = K.LOWER[buf]
            cls = _CLASS[buf]
            edge = np.ones(len(buf) + 1, bool)
            a, b = cls[:-1], cls[1:]
            edge[1:-1] = (a != b) & ((a == 0) | (b == 0) | ((a != _OTHER) & (b != _OTHER)))
            edge[offs] = True
            cut = np.flatnonzero(edge)
            starts, ends = cut[:-1], cut[1:]
            full = cls[starts] != 0
            starts, ends = starts[full], ends[full]
            uoffs = np.searchsorted(starts, offs)
            h = K.span_hash(K.prefix_hash(lower), starts, ends) if len(starts) else np.empty(0, np.uint64)
            units = self._units(h, starts, ends, lower)
            units = np.insert(units, uoffs[1:], 0)  # unit 0 is END
            uoffs = uoffs + np.arange(len(uoffs))
            size = self.ends[units + 1] - self.ends[units]
            stop = np.concatenate([[0], np.cumsum(size)])
            ids = self.ids[np.repeat(self.ends[units] - stop[:-1], size) + np.arange(stop[-1])]
            toffs = stop[uoffs]
            yield from self._special(first, last, buf, offs, ids, toffs)

    def _units(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: np.ndarray) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.forget()
        distinct, index, back = np.unique(h, return_index=True, return_inverse=True)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
            new = self.known[at] != distinct
        if new.any():
            raw = lower.tobytes()
            self._learn(distinct[new], [raw[starts[k] : ends[k]] for k in index[new]])
        if not len(distinct):
            return np.empty(0, np.int64)
        return self.at[np.searchsorted(self.known, distinct)][back]

    def _special(self, first: int, last: int, buf: np.ndarray, offs: np.ndarray, ids: np.ndarray, toffs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Tokenizes texts with a special token's own string anew, whole: those strings are told apart by case."""
        raw, rows = buf.tobytes(), set()
        for s in self.special:
            p = raw.find(s.lower()) if s.lower() in raw.lower() else -1
            low = raw.lower() if p >= 0 or s.lower() in raw.lower() else b""
            p = low.find(s.lower())
            while p >= 0:
                k = int(np.searchsorted(offs, p, "right")) - 1
                rows.add(k)
                p = low.find(s.lower(), int(offs[k + 1]))
        if not rows:
            yield first, last, ids, toffs
            return
        parts = [ids[toffs[k] : toffs[k + 1]] if k not in rows else np.array([*self.tokenizer.encode(raw[offs[k] : offs[k + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, END], np.uint32) for k in range(last - first)]
        yield first, last, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def _measure(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        n_tokens, windows, steps = [], [], []
        for _, _, ids, offs in _tokens(path).encode(batch.column(1)):
            raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                rest = a + (b - a) // WINDOW * WINDOW
                n_tokens.append(b - a)
                windows.append(np.array([zlib.crc32(raw[4 * k : 4 * (k + WINDOW)]) for k in range(a, rest, WINDOW)], "<u4").tobytes())
                steps.append(np.array([zlib.crc32(raw[4 * k : 4 * min(k + STEP, b)]) for k in range(rest, b, STEP)] + [zlib.crc32(raw[4 * rest : 4 * b])] * (b > rest), "<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(windows, pa.binary()), pa.array(steps, pa.binary()), pa.array(np.arange(batch.num_rows, dtype=np.int32))], names=["doc_id", "n_tokens", "windows", "steps", "place"])


# Checksums ------------------------------------------------------------------


def _zero_step(c: int) -> int:
    for _ in range(8):
        c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
    return c


@lru_cache(STEP * 4 + 1)
def _shift_table(n: int) -> tuple[tuple[int, ...], ...]:
    """The checksum's change over n zero bytes, a linear map, by its four bytes."""
    basis = []
    for bit in range(32):
        c = 1 << bit
        for _ in range(n):
            c = _zero_step(c)
        basis.append(c)
    return tuple(tuple(_xor(basis[8 * k : 8 * k + 8], v) for v in range(256)) for k in range(4))


def _xor(basis: list[int], v: int) -> int:
    out = 0
    for bit, x in enumerate(basis):
        if v >> bit & 1:
            out ^= x
    return out


def combined(crcs: list[int], sizes: list[int]) -> int:
    """The CRC-32 of parts put together, from the parts' own and their sizes in bytes (at most 4 * STEP)."""
    total = 0
    for c, n in zip(crcs, sizes, strict=True):
        t = _shift_table(n)
        total = t[0][total & 255] ^ t[1][total >> 8 & 255] ^ t[2][total >> 16 & 255] ^ t[3][total >> 24] ^ c
    return total


# Packing --------------------------------------------------------------------


@lru_cache(4)
def combinations(cells: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All ways to fill ``cells`` with at most ``depth`` lengths: the lengths (0: none) and their counts by length."""
    found = []

    def extend(left: int, most: int, own: tuple[int, ...]) -> None:
        if not left:
            found.append(own + (0,) * (depth - len(own)))
        elif len(own) < depth:
            for x in range(min(left, most), (left - 1) // (depth - len(own)), -1):
                extend(left - x, x, (*own, x))

    extend(cells, cells, ())
    sets = np.array(found)
    a = np.zeros((cells + 1, len(sets)))
    for k in range(depth):
        np.add.at(a, (sets[:, k], np.arange(len(sets))), 1)
    return sets, a[1:]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Non-negative least squares by an active set: min |a x - b| over x >= 0."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds or 3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= 1e-8 * max(1.0, float(np.abs(b).max())):
            break
        free[k] = True
        while True:
            at = np.flatnonzero(free)
            y = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if y.min(initial=1.0) > 1e-12:
                x[:] = 0
                x[at] = y
                break
            bad = y <= 1e-12
            old = x[at]
            step = float(np.min(old[bad] / np.maximum(old[bad] - y[bad], 1e-300)))
            x[at] = old + step * (y - old)
            drop = at[x[at] <= 1e-12]
            drop = drop if len(drop) else at[bad][:1]
            x[drop] = 0
            free[drop] = False
            if not free.any():
                break
    return x


def fill(items: list[tuple[int, list[int]]], window: int) -> tuple[list[tuple[int, list[int]]], list[tuple[int, list[int]]]]:
    """Items (length, documents) put together to fill the window by the plan, and those that are left."""
    cells = min(CELLS, window)
    step = window // cells
    by_cell: dict[int, list[int]] = {}
    for k, (n, _) in enumerate(items):
        by_cell.setdefault(-(-n // step), []).append(k)
    histogram = np.array([len(by_cell.get(c + 1, ())) for c in range(cells)], float)
    sets, a = combinations(cells, DEPTH)
    columns = np.flatnonzero(~np.any(a[histogram == 0] > 0, axis=0))
    out = []
    if len(columns):
        repeats = nnls(a[:, columns], histogram)
        whole = np.floor(repeats + 1e-6)
        rounds = [(k, int(whole[k])) for k in np.argsort(-repeats, kind="stable")] + [(k, 1) for k in np.argsort(whole - repeats, kind="stable") if repeats[k] - whole[k] > 1e-6]
        for k, times in rounds:
            own = [int(c) for c in sets[columns[k]] if c]
            for _ in range(times):
                if any(len(by_cell[c]) < own.count(c) for c in own):
                    break
                picked = [by_cell[c].pop() for c in own]
                out.append((sum(items[k][0] for k in picked), [d for k in picked for d in items[k][1]]))
    return out, [items[k] for c in sorted(by_cell, reverse=True) for k in by_cell[c]]


def plan(lengths: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """Documents of each sequence that the levels' plans fill, and the documents that are left, the longest items first."""
    carried: list[tuple[int, list[int]]] = []
    rest = np.argsort(lengths, kind="stable")
    window = LEAST_WINDOW
    while True:
        n = len(rest) if window == WINDOW else int(np.searchsorted(lengths[rest], window // 2))
        filled, left = fill(carried + [(int(lengths[k]), [int(k)]) for k in rest[:n]], window)
        rest = rest[n:]
        if window == WINDOW:
            return [own for _, own in filled], [d for _, own in left for d in own]
        carried = left + filled
        window *= 2


def pack(lengths: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold each of the lengths (1 to WINDOW - 1) once."""
    planned, left = plan(lengths)
    out = [[(d, 0, int(lengths[d])) for d in own] for own in planned]
    row: list[tuple[int, int, int]] = []
    room = WINDOW
    for d in left:
        start, n = 0, int(lengths[d])
        while n > room:
            if part := room // STEP * STEP:
                row.append((d, start, part))
                start, n = start + part, n - part
            out.append(row)
            row, room = [], WINDOW
        row.append((d, start, n))
        room -= n
        if not room:
            out.append(row)
            row, room = [], WINDOW
    return out + [row] if row else out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs the documents of a partition; the sequences' ids begin with the partition's number."""
    from pyspark import TaskContext

    table = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())], names=["doc_id", "n_tokens", "windows", "steps"])])
    if not table.num_rows:
        return
    rows = sorted(zip(*(c.to_pylist() for c in table.columns), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2]))
    sequence = TaskContext.get().partitionId() << 40
    out: list[tuple] = []
    rest: list[tuple[int, int]] = []
    for k, (doc, n, windows, _) in enumerate(rows):
        for w, crc in enumerate(np.frombuffer(windows, "<u4").tolist()):
            out.append((doc, w * WINDOW, WINDOW, crc, n, sequence, 0))
            sequence += 1
        if n % WINDOW:
            rest.append((k, n % WINDOW))
    for row in pack(np.array([n for _, n in rest], np.int64)):
        offset = 0
        for d, start, length in row:
            k, whole = rest[d]
            doc, n, _, steps = rows[k]
            crcs = np.frombuffer(steps, "<u4").tolist()
            if length == whole:
                crc = crcs[-1]
            else:
                some = range(start // STEP, -(-(start + length) // STEP))
                crc = combined([crcs[s] for s in some], [4 * (min((s + 1) * STEP, whole) - s * STEP) for s in some])
            out.append((doc, n - whole + start, length, crc, n, sequence, offset))
            offset += length
        sequence += 1
    names = [x.split()[0] for x in _PIECES.split(", ")]
    for k in range(0, len(out), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[k : k + 50_000], strict=True)], names=names)


def pack_documents(docs: DataFrame, tokenizer_path: str, group: int = GROUP) -> DataFrame:
    """Pieces of all documents, each with the place where it stands in a sequence of at most WINDOW tokens."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    groups = max(1, -(-docs.count() // group))
    measured = docs.mapInArrow(K.frugal(lambda it: _measure(it, tokenizer_path)), "doc_id long, n_tokens long, windows binary, steps binary, place int")
    return measured.repartition(groups, F.xxhash64("doc_id", "n_tokens", "steps", "place")).drop("place").mapInArrow(K.frugal(_pack_group), _PIECES)
