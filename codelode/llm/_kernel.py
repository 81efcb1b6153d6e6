"""Vectorised text kernels shared by the corpus operators.

Every kernel works on the raw UTF-8 buffer of an Arrow string column, so that
no Python string is made for a word.  Texts are handled in chunks that fit a
CPU's cache, cut only between documents; a null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one chunk aims at; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 18

#: ASCII white space: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Everything that is not an ASCII letter, a digit or non-ASCII.
NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x41:0x5B] = NOT_WORD[0x61:0x7B] = NOT_WORD[0x80:] = False

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit; works in place on a fresh array."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return h


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span."""
    p, _ = powers(len(buf))
    terms = buf.astype(np.uint64)
    terms += np.uint64(1)
    terms *= p[: len(buf)]
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(terms, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends); equal bytes have equal hashes wherever they stand."""
    _, inv = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inv[starts])


def chunks(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, limit = len(column), limit or CHUNK_BYTES
    if not n:
        return
    column = column.cast(pa.large_binary()) if column.type not in (pa.string(), pa.binary()) else column
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = column.fill_null(b"" if not pa.types.is_string(column.type) else "")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without a separator, and the runs before each document."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    body = ~sep[buf]
    first, last = body.copy(), body.copy()
    first[1:] &= ~body[:-1]
    last[:-1] &= ~body[1:]
    begins, ends = offs[:-1][offs[:-1] < len(buf)], offs[1:][offs[1:] > 0] - 1
    first[begins] = body[begins]
    last[ends] = body[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


_STEP = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2D358DCCAA6C78A5)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, at each word but the last n - 1; windows may cross documents."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1] * _STEP[0]
    for k in range(1, n):
        out += (h[k : len(h) - n + 1 + k] ^ (h[k : len(h) - n + 1 + k] >> np.uint64(31))) * _STEP[k]
    return mix(out)


def gram_sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``long_grams`` takes the hashes of any number of words."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * powers(len(h))[0][: len(h)], out=sums[1:])
    return sums


def long_grams(sums: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, at each word but the last n - 1; windows may cross documents."""
    m = max(len(sums) - n, 0)
    return mix((sums[n:] - sums[:m]) * powers(m)[1][:m]) if m else np.empty(0, np.uint64)


def inside(woffs: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the windows of n words stand inside one document; total: the windows."""
    ok = np.ones(max(total, 0), bool)
    for k in range(1, n):
        ends = woffs[1:] - k
        ends = ends[(ends >= 0) & (ends < total)]
        ok[ends] = False
    return ok


def per_doc(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values between the offsets."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def doc_of(offs: np.ndarray) -> np.ndarray:
    """The document of each element, from the offsets of the documents."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def code_points(buf: np.ndarray) -> np.ndarray:
    """Flags of the bytes that begin a code point."""
    return (buf & 0xC0) != 0x80


def runs(cls: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one class but 0, and the runs before each document."""
    if not len(cls):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    edge = np.ones(len(cls) + 1, bool)
    np.not_equal(cls[1:], cls[:-1], out=edge[1:-1])
    edge[offs] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    full = cls[starts] != 0
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes that ``span_hash`` gives to these words, sorted."""
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return np.sort(span_hash(prefix_hash(buf), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends))


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives freed memory back, as Spark keeps workers for other tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass
