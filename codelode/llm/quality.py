"""Quality rules: hashed n-gram log-likelihood ratio of trusted and raw text.

Two multinomials over hashed 1- and 2-grams of tokens are counted: one over a
bounded sample of documents that labels call good (``target_rows``), one over
every document of the corpus.  A document's score is the mean, over its n-grams,
of the logarithm of the ratio of the two probabilities.  Ratios are rounded to
integers before they are added, so a score depends on the text alone and not on
how the rows are split.  The threshold comes from labelled rows as well; it is
a number that every document is held against.

A mean over a whole text does not see a few toxic words in good prose.  A second
ratio does: of the labelled documents that hold a word, good against toxic ones
(lower case, buckets of its own).  A document's harm is the mean of its WORST
least ratios over different words, with a threshold of its own.

Edge cases: a null text is an empty one; a text without a word has score 0.0 and
fails the base rule; repeated rows are scored row by row; an empty corpus gives
no rows; without labels the method passes every document, and without toxic
ones (or with too few to tune on) no document is harmful.  Labels with a null
doc_id or quality are ignored, and rows of one doc_id are merged (the worst counts).
Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codelode.llm import _kernel as K

#: n-gram buckets of the two multinomials (a power of two).
BUCKETS = 1 << 16
#: Word buckets of the ratio of good and toxic rows (a power of two), and the words of a document that its harm is taken from.
HARM_BUCKETS, WORST = 1 << 20, 3
#: Added to each bucket's count.
SMOOTHING, HARM_SMOOTHING = 0.5, 2.0
#: Log ratios are rounded to multiples of 1 / SCALE.
SCALE = 1 << 20
#: The most labelled rows that each sample takes, by the hash of their ids.
TARGET_ROWS, TUNING_ROWS = 20_000, 2_000
#: The share of good labelled rows that may fall below each threshold.
GOOD_LOSS = 0.005

_CLASS = np.where(K.SPACE, 0, np.where(K.NOT_WORD, 2, 1)).astype(np.uint8)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


@dataclass(frozen=True)
class Model:
    """Log ratios by bucket, times SCALE, and the least score that passes (None: all pass); likewise for harm."""

    ratios: np.ndarray
    threshold: float | None
    harm_ratios: np.ndarray | None = None
    harm_threshold: float | None = None


def _features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and each one's document."""
    starts, ends, toffs = K.runs(_CLASS[buf], offs)
    h = K.span_hash(K.prefix_hash(buf), starts, ends)
    two = K.grams(h, 2)
    ok = K.inside(toffs, 2, len(two))
    docs = K.doc_of(toffs)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    return np.concatenate([h >> shift, two[ok] >> shift]).astype(np.int64), np.concatenate([docs, docs[: len(two)][ok]])


def _scores(buf: np.ndarray, offs: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    buckets, docs = _features(buf, offs)
    n = len(offs) - 1
    count = np.bincount(docs, minlength=n)
    order = np.argsort(docs, kind="stable")
    total = K.per_doc(ratios[buckets[order]], np.concatenate([[0], np.cumsum(count)]))
    return total / np.maximum(count, 1) / SCALE


def _distinct_words(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Document * HARM_BUCKETS + bucket of each document's different words in lower case, sorted."""
    starts, ends, toffs = K.runs(_CLASS[buf], offs)
    h = K.span_hash(K.prefix_hash(K.LOWER[buf]), starts, ends)
    return np.unique(K.doc_of(toffs) * HARM_BUCKETS + (h >> np.uint64(64 - (HARM_BUCKETS.bit_length() - 1))).astype(np.int64))


def _ratios(harmful: np.ndarray, harmless: np.ndarray, n_harmful: int | np.ndarray, n_harmless: int | np.ndarray) -> np.ndarray:
    """Log ratios of good and toxic documents, in multiples of 1 / SCALE; those above 0, and of buckets without a toxic document, are 0."""
    share = lambda count, n: np.log((count + HARM_SMOOTHING) / (n + 2 * HARM_SMOOTHING))
    return np.rint(np.where(harmful > 0, np.minimum(share(harmless, n_harmless) - share(harmful, n_harmful), 0), 0) * SCALE).astype(np.int32)


def _harms(buf: np.ndarray, offs: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The mean of the WORST least ratios of each document's words; missing words count as 0."""
    words = _distinct_words(buf, offs)
    return _worst(ratios[words % HARM_BUCKETS], words // HARM_BUCKETS, offs)


def _worst(values: np.ndarray, docs: np.ndarray, offs: np.ndarray) -> np.ndarray:
    values, docs = values[values < 0], docs[values < 0]
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    worst = np.arange(len(docs)) - np.searchsorted(docs, docs) < WORST
    return np.bincount(docs[worst], values[worst], len(offs) - 1) / WORST / SCALE


def base_rules(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    n = len(offs) - 1
    starts, ends, woffs = K.words(buf, offs)
    sums = K.prefix_hash(buf)
    five = K.grams(K.span_hash(sums, starts, ends), 5)
    ok = np.flatnonzero(K.inside(woffs, 5, len(five)))
    own = K.mix(five[ok] + K.doc_of(woffs)[ok].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    ordered = np.sort(own)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        hit = ok[twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own]
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 5, -1)
        repeat = K.per_doc(np.cumsum(cover[:-1]) > 0, woffs)
    else:
        repeat = np.zeros(n, np.int64)
    lstarts, lends, loffs = K.words(buf, offs, _NEWLINE)
    full = np.searchsorted(starts, lends) > np.searchsorted(starts, lstarts)
    ldocs = K.doc_of(loffs)[full]
    lines = K.mix(K.span_hash(sums, lstarts[full], lends[full]) + ldocs.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(lines, kind="stable")
    again = lines[order][1:] == lines[order][:-1]
    out = {
        "n_words": np.diff(woffs),
        "word_chars": K.per_doc(K.code_points(buf) & ~K.SPACE[buf], offs),
        "n_symbols": K.per_doc(_SYMBOL[buf], offs),
        "n_dup_lines": np.bincount(ldocs[order[1:][again]], minlength=n),
        "n_repeat_words": repeat,
    }
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    return out


def _left_out(batches: Iterator[pa.RecordBatch], harmful: np.ndarray, harmless: np.ndarray, n_harmful: int, n_harmless: int, toxic: frozenset) -> Iterator[pa.RecordBatch]:
    """(doc_id, harm) of counted documents, each by the counts without its own."""
    for batch in batches:
        marked = np.fromiter((x in toxic for x in batch.column(0).to_pylist()), np.int64, batch.num_rows)
        for at, to, buf, offs in K.chunks(batch.column(1)):
            words = _distinct_words(buf, offs)
            bucket, docs = words % HARM_BUCKETS, words // HARM_BUCKETS
            own = marked[at:to][docs]
            values = _ratios(harmful[bucket] - own, harmless[bucket] - (1 - own), n_harmful - own, n_harmless - (1 - own))
            yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], pa.array(_worst(values, docs, offs))], names=["doc_id", "harm"])


def _count(batches: Iterator[pa.RecordBatch], good: frozenset, harmless: frozenset, toxic: frozenset) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, raw, target) of one partition, a row for each bucket that it has.

    From BUCKETS on, the buckets are those of harm, and the rows (bucket, toxic documents, good documents).
    """
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    with_harm, without = np.zeros(HARM_BUCKETS, np.int32), np.zeros(HARM_BUCKETS, np.int32)
    for batch in batches:
        ids = batch.column(0).to_pylist()
        fair = np.fromiter((x in harmless for x in ids), bool, batch.num_rows)
        trusted = np.fromiter((x in good for x in ids), bool, batch.num_rows)
        marked = np.fromiter((x in toxic for x in ids), bool, batch.num_rows)
        for at, to, buf, offs in K.chunks(batch.column(1)):
            buckets, docs = _features(buf, offs)
            raw += np.bincount(buckets, minlength=BUCKETS)
            if trusted[at:to].any():
                target += np.bincount(buckets[trusted[at:to][docs]], minlength=BUCKETS)
            if toxic and (fair[at:to] | marked[at:to]).any():
                words = _distinct_words(buf, offs)
                for sums, own in ((with_harm, marked), (without, fair)):
                    found, n = np.unique(words[own[at:to][words // HARM_BUCKETS]] % HARM_BUCKETS, return_counts=True)
                    sums[found] += n.astype(np.int32)
    for first, a, b in ((0, raw, target), (BUCKETS, with_harm, without)):
        at = np.flatnonzero(a + b)
        yield pa.RecordBatch.from_arrays([pa.array(at + first), pa.array(a[at].astype(np.int64)), pa.array(b[at].astype(np.int64))], names=["bucket", "raw", "target"])


def _sample(labels: DataFrame, kind: str, rows: int) -> list:
    """At most ``rows`` ids of labelled documents of a kind (good, bad: not good, or toxic), those with the least hashes."""
    toxic = F.coalesce("toxic", F.lit(0)) >= 1
    merged = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.bool_or((F.col("quality") < 1) | toxic).alias("bad"), F.bool_or(toxic).alias("toxic"))
    wanted = ~F.col("bad") if kind == "good" else F.col(kind)
    return [r[0] for r in merged.filter(wanted).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id").collect()]


def fit(docs: DataFrame, labels: DataFrame, *, target_rows: int = TARGET_ROWS, tuning_rows: int = TUNING_ROWS, good_loss: float = GOOD_LOSS) -> Model:
    """Counts both multinomials and sets the threshold.

    The raw multinomial counts every document.  The target's rows and the tuning
    rows are bounded samples of labelled rows.  The threshold is the one that
    separates good from bad tuning rows best (the sum of both rates), lowered
    until at most ``good_loss`` of the good rows fall below it.  Harm is counted
    over the good sample and as many toxic rows, and its threshold is set in the same
    way, from rows of both that are scored by the counts without their own.
    """
    docs = docs.select("doc_id", "text")
    good = _sample(labels, "good", target_rows + tuning_rows)
    held = min(tuning_rows, len(good) // 4)  # these set the threshold and so stay out of the target's counts
    known = frozenset(good[held:])
    toxic_ids = _sample(labels, "toxic", target_rows)
    toxic = frozenset(toxic_ids)
    fair = frozenset(good[:target_rows])
    counted = docs.mapInArrow(K.frugal(lambda it: _count(it, known, fair, toxic)), "bucket long, raw long, target long")
    # A bucket of harm without a toxic document has no ratio below 0.
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).filter(f"bucket < {BUCKETS} or raw > 0").toArrow()
    bucket, r, t = (sums.column(k).to_numpy() for k in range(3))
    wide = np.zeros((2, BUCKETS + HARM_BUCKETS))
    wide[0, bucket], wide[1, bucket] = r, t
    raw, target, harmful, harmless = wide[0, :BUCKETS], wide[1, :BUCKETS], wide[0, BUCKETS:], wide[1, BUCKETS:]
    if not target.any():
        return Model(np.zeros(BUCKETS, np.int64), None)
    ratio = np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS))
    ratios = np.rint(ratio * SCALE).astype(np.int64)
    harmful, harmless = harmful.astype(np.int32), harmless.astype(np.int32)
    harm_ratios = _ratios(harmful, harmless, len(toxic), len(fair)) if toxic else None
    bad = _sample(labels, "bad", tuning_rows)
    some = lambda ids: docs.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in ids], "doc_id long")), "doc_id", "left_semi")
    rows = some({*good[:held], *bad}).mapInArrow(K.frugal(lambda it: _verdicts(it, Model(ratios, None))), _SCHEMA).filter(~F.col("base_failed")).select("doc_id", "score").collect()
    marks = frozenset(bad)
    own = sorted((r["score"], r["doc_id"] in marks) for r in rows)
    if not toxic:
        return Model(ratios, _threshold(own, good_loss))
    tuned = {*good[:tuning_rows], *toxic_ids[:tuning_rows]}
    rows = some(tuned).mapInArrow(K.frugal(lambda it: _left_out(it, harmful, harmless, len(toxic), len(fair), toxic)), "doc_id long, harm double").collect()
    worst = sorted((r["harm"], r["doc_id"] in toxic) for r in rows)
    return Model(ratios, _threshold(own, good_loss), harm_ratios, _threshold(worst, good_loss))


def _threshold(own: list[tuple[float, bool]], good_loss: float) -> float | None:
    good = np.array([s for s, bad in own if not bad])
    bad = np.array([s for s, bad in own if bad])
    if not len(good) or not len(bad):
        return None
    at = np.unique(np.concatenate([good, bad]))
    below = np.searchsorted(bad, at) / len(bad) - np.searchsorted(good, at) / len(good)
    return float(min(at[int(np.argmax(below))], good[int(good_loss * len(good))]))


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double, harm double"


def _judged(column: pa.Array, model: Model) -> dict[str, np.ndarray]:
    """All columns of a verdict but the id, for a column of texts."""
    parts: dict[str, list] = {}
    for _, _, buf, offs in K.chunks(column):
        out = base_rules(buf, offs)
        out["score"] = _scores(buf, offs, model.ratios)
        passed = out["score"] >= model.threshold if model.threshold is not None else np.ones(len(offs) - 1, bool)
        out["harm"] = _harms(buf, offs, model.harm_ratios) if model.harm_ratios is not None else np.zeros(len(offs) - 1)
        if model.harm_threshold is not None:
            passed = passed & (out["harm"] >= model.harm_threshold)
        out["kept"] = ~out["base_failed"] & passed
        for k, v in out.items():
            parts.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in parts.items()}


def _verdicts(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for batch in batches:
        if batch.num_rows:
            own = _judged(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(own[k]) for k in names[1:])], names=names)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each document: its base counts, its score and the verdict."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(K.frugal(lambda it: _verdicts(it, model)), _SCHEMA).drop("harm")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that pass, with all their columns, in one pass without a shuffle."""
    at = docs.columns.index("text")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_judged(batch.column(at), model)["kept"]))

    return docs.mapInArrow(K.frugal(passed), docs.schema)
