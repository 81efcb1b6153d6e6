"""Language identification by families and pairs.

A text becomes a vector of hashed byte 1- to 3-grams (letters in lower case,
other ASCII as a space; square roots of frequencies, length 1).  Linear support
vector machines decide in two levels: each language family against all others,
then one-versus-one between the languages of the family that won.  All are
trained from a bounded sample of labelled rows by dual coordinate descent.  Every
language that has a labelled row is learned; only the rows of each are bounded.

Edge cases: a text that is null or without a letter (Unicode's, so ``\u00b2`` and ``\u00bd`` are
none) is ``und`` with score 0.0; if nothing can be learned every text is ``und``; one
learned language is the answer for every text with a letter; ties go to the name
that sorts first; repeated rows are judged row by row, and the sample takes one of
the rows with the same id and language (the least text); a very long text is a chunk
of its own, whose vector is no longer than any; an empty table gives no rows.  The
prediction reads the text alone; only the fit reads the language, and further
columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codelode.llm import _kernel as K

#: Entries of a feature vector (a power of two).
WIDTH = 4096
#: Texts whose vectors are held at a time, in doubles.
ROWS = 128
#: The most labelled rows that the sample takes of each language, those with the least hashes of id; and of all
#: languages together (32 KB each on the driver; each language has LEAST_ROWS in any case).
SAMPLE_ROWS, ALL_ROWS, LEAST_ROWS = 400, 16_000, 20

#: Families by ISO 639-1 code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
    "austronesian": ("id", "jv", "mg", "ms", "tl"),
}

_FOLD = np.where(K.NOT_WORD, 0x20, K.LOWER).astype(np.uint8)
_FOLD[0x30:0x3A] = 0x20
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
_FACTORS = ((1,), (0x9E3779B1, 0x85EBCA77), (0xC2B2AE3D, 0x27D4EB2F, 0x165667B1))


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, vectors) of runs of rows."""
    shift = np.uint32(32 - (WIDTH.bit_length() - 1))
    parts = ((k, *c) for k in range(0, len(column), ROWS) for c in K.chunks(column.slice(k, ROWS)))
    for first, at, to, buf, offs in parts:
        at, to, n = first + at, first + to, to - at
        text = _FOLD[buf].astype(np.uint32)
        doc = np.repeat(np.arange(n, dtype=np.int64) * WIDTH, np.diff(offs))
        counts = np.zeros(n * WIDTH)
        for size, factors in enumerate(_FACTORS, 1):
            m = len(text) - size + 1
            if m <= 0:
                break
            h = text[:m] * np.uint32(factors[0])
            for k in range(1, size):
                h ^= text[k : m + k] * np.uint32(factors[k])
            h = (h * np.uint32(0x9E3779B1) + np.uint32(size * 0x1234567)) * np.uint32(0x85EBCA6B) >> shift
            ok = doc[:m] == doc[size - 1 :]
            counts += np.bincount(doc[:m][ok] + h[ok], minlength=n * WIDTH)
        counts = counts.reshape(n, WIDTH)
        yield at, to, np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def margins(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Products of vectors and machines, constants added, in multiples of 2 ** -16 for either side.

    Sums of whole numbers below 2 ** 53 are exact in doubles, so a row's margins do not depend on the rows beside it.
    """
    fixed = lambda v: np.rint(v.astype(np.float64) * 65536)
    return fixed(x) @ fixed(weights[:, :-1]).T / 65536**2 + weights[:, -1].astype(np.float64)


def svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 20) -> np.ndarray:
    """Weights of a linear support vector machine (hinge loss), with a last entry for the constant; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, alpha, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    order = np.random.default_rng(3)
    for _ in range(rounds):
        moved = 0.0
        for k in order.permutation(len(x)):
            old = alpha[k]
            alpha[k] = min(max(old - (y[k] * (x[k] @ w) - 1) / q[k], 0.0), c)
            if alpha[k] != old:
                w += (alpha[k] - old) * y[k] * x[k]
                moved = max(moved, abs(alpha[k] - old))
        if moved < 1e-3:
            break
    return w


@dataclass(frozen=True)
class Votes:
    """One-versus-one machines between names; positive: the first of the pair."""

    names: tuple[str, ...]
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner's place in names and its probability-like score, for each row."""
        n = len(self.names)
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        p = 1 / (1 + np.exp(-2 * margins(x, self.weights)))
        won, sure = np.zeros((len(x), n)), np.zeros((len(x), n))
        for k, (a, b) in enumerate(self.pairs):
            won[:, a] += p[:, k] >= 0.5
            won[:, b] += p[:, k] < 0.5
            sure[:, a] += p[:, k]
            sure[:, b] += 1 - p[:, k]
        best = np.argmax(won + sure / (2 * n), 1)
        return best, sure[np.arange(len(x)), best] / (n - 1)


def votes(x: np.ndarray, names: np.ndarray) -> Votes:
    every = tuple(sorted(set(names)))
    pairs = tuple(combinations(range(len(every)), 2))
    weights = [svm(x[mask], np.where(names[mask] == every[a], 1.0, -1.0)) for a, b in pairs for mask in [(names == every[a]) | (names == every[b])]]
    return Votes(every, pairs, np.array(weights, np.float32).reshape(len(pairs), x.shape[1] + 1))


@dataclass(frozen=True)
class Rivals:
    """One machine for each name against all others; none for a single name."""

    names: tuple[str, ...]
    weights: np.ndarray

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in names of the widest margin and its share of all names' odds, for each row."""
        if len(self.names) == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = margins(x, self.weights)
        best = np.argmax(margin, 1)
        p = 1 / (1 + np.exp(-2 * margin))
        return best, p[np.arange(len(x)), best] / np.maximum(sum(p.T), 1e-9)


def rivals(x: np.ndarray, names: np.ndarray) -> Rivals:
    every = tuple(sorted(set(names)))
    weights = [svm(x, np.where(names == name, 1.0, -1.0)) for name in every[: 1 if len(every) == 2 else None]] if len(every) > 1 else []
    if len(every) == 2:  # the second's machine is the first's, mirrored
        weights.append(-weights[0])
    return Rivals(every, np.array(weights, np.float32).reshape(len(weights), x.shape[1] + 1))


@dataclass(frozen=True)
class Model:
    families: Rivals
    within: dict[str, Votes]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, score = self.families.decide(x)
        out, score = np.empty(len(x), object), score.copy()
        for k, name in enumerate(self.families.names):
            rows = np.flatnonzero(family == k)
            if len(rows):
                best, own = self.within[name].decide(x[rows])
                out[rows] = np.array(self.within[name].names, object)[best]
                score[rows] *= own
        return out.tolist(), np.clip(score, 0.0, 1.0)


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


def train(x: np.ndarray, langs: list[str]) -> Model | None:
    if not len(x):
        return None
    langs = np.array(langs, object)
    families = np.array([family_of(v) for v in langs], object)
    return Model(rivals(x, families), {f: votes(x[families == f], langs[families == f]) for f in sorted(set(families))})


def fit(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, all_rows: int = ALL_ROWS) -> Model | None:
    """Trains on the sample of the rows given; they have doc_id, text and lang.

    The sample is bounded: ``sample_rows`` of each language, ``all_rows`` in all (but ``LEAST_ROWS`` of each).  One
    aggregate over ids says how small a hash must be for that, and one scan takes the rows with such hashes.
    """
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).filter("lang is not null and text is not null and doc_id is not null")
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("ids"))
    counted = sizes.collect()  # a row for each language
    if not counted:
        return None
    share = min(sample_rows, max(LEAST_ROWS, all_rows // len(counted)))
    least = docs.sparkSession.createDataFrame([(r["lang"], (1.5 * share + 20) / max(1, r["ids"])) for r in counted], "lang string, below double")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(float(1 << 63))
    some = known.join(F.broadcast(least), "lang").filter(place < F.col("below")).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")))
    sample = ranked.filter(F.col("rank") <= share).select("doc_id", "text", "lang")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, x in features(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], batch.column(2)[at:to], pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "lang", "x"])

    rows = sample.mapInArrow(K.frugal(vectors), "doc_id long, lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"]))
    return train(np.array([np.frombuffer(r["x"]) for r in rows]).reshape(len(rows), WIDTH), [r["lang"] for r in rows])


def is_held_out(doc_id: int | None) -> bool:
    """Whether a document is kept out of the fit: crc32 of its id as text, modulo 3, is 1 (a null id never is)."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text holds a letter of Unicode; only texts without one of ASCII are decoded."""
    out = np.zeros(len(column), bool)
    for at, to, buf, offs in K.chunks(column):
        out[at:to] = K.per_doc(_ASCII_LETTER[buf], offs) > 0
    for k in np.flatnonzero(~out).tolist():
        out[k] = any(c.isalpha() for c in column[k].as_py() or "")
    return out


_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row for each document: the language of its whole text and a score from 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            lettered = has_letter(texts)
            for at, to, x in features(texts) if batch.num_rows else ():
                langs, scores = model.predict(x) if model else (["und"] * (to - at), np.zeros(to - at))
                for k in np.flatnonzero(~lettered[at:to]).tolist():
                    langs[k], scores[k] = "und", 0.0
                own = ids[at:to]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], pa.array([is_held_out(v) for v in own]), pa.array(langs, pa.string()), pa.array(np.asarray(scores, np.float64))], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(K.frugal(run), _SCHEMA)
