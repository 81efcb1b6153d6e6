"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers.

Two first-order Markov models over the characters of tokens are trained from
labelled samples: random strings (keys in hexadecimal, base 32, base 64 and
mixed alphabets, drawn with a fixed seed) and ordinary identifiers (the words of
a bounded sample of documents, alone and joined the way names in code are, and
numbers and dates as they are written).  A run of token characters, of any length, is
a secret if the log-likelihood ratio of the two models is at least ``LEAST`` in all and
``LEAST_EACH`` per character; of a run that is none, the parts between ``/`` and ``=`` are
judged likewise.  Runs that touch a span of the fixed patterns are left to those.
Ratios are integers, so a run's sum depends on its characters alone.

Edge cases: a null or empty text has no spans; very long texts are judged whole, in time
that grows with their length; repeated rows are scanned row by row; an empty table
gives no rows; offsets are code points; spans with equal starts are listed by kind.  Only
the id and the text are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codelode.llm import _kernel as K

#: Kinds of spans in the order in which equal starts are listed; the last is the method's.
KINDS = ("assign", "access", "hex", "markov")
#: The least log-likelihood ratio (natural) of a secret, in all and per character; ratios are rounded to multiples of 1 / SCALE.
LEAST, LEAST_EACH, SCALE = 18.0, 0.35, 1 << 20
#: The most documents and distinct words that the sample of identifiers takes.
SAMPLE_DOCS, SAMPLE_WORDS = 500, 20_000

ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs [0-9a-f]+ of 24 characters or more
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_IN_PART = _IN_TOKEN.copy()
_IN_PART[list(b"/=")] = False
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios, times SCALE, of a first character (256) and of a character after another (256 x 256)."""

    first: np.ndarray
    after: np.ndarray

    def ratios(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ratio of each run of bytes."""
        sums = np.zeros(max(len(buf), 1), np.int64)
        np.cumsum(self.after[buf[:-1], buf[1:]], out=sums[1:])
        return self.first[buf[starts]] + sums[ends - 1] - sums[starts]

    def secrets(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the secrets of texts, in order."""

        def judged(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            starts, ends, _ = K.words(buf, offs, ~inside)
            ratio = self.ratios(buf, starts, ends) if len(starts) else np.empty(0, np.int64)
            return starts, ends, (ratio >= int(LEAST * SCALE)) & (ratio >= (LEAST_EACH * SCALE * (ends - starts)).astype(np.int64))

        starts, ends, ok = judged(_IN_TOKEN)
        parts, part_ends, part_ok = judged(_IN_PART)
        part_ok &= ~ok[np.searchsorted(starts, parts, "right") - 1] if len(parts) else False
        first, last = np.concatenate([starts[ok], parts[part_ok]]), np.concatenate([ends[ok], part_ends[part_ok]])
        order = np.argsort(first)
        return first[order], last[order]

    def is_secret(self, token: str) -> bool:
        raw = np.frombuffer(token.encode(), np.uint8)
        return len(self.secrets(raw, np.array([0, len(raw)]))[0]) > 0


def random_strings(n: int, seed: int = 7) -> list[str]:
    """n labelled samples of random keys."""
    rng = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [digits + "abcdef", digits + "ABCDEF", upper + "234567", upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_"]
    return ["".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(20, 64))) for k in range(n)]


def identifiers(words: list[str], n: int, seed: int = 11) -> list[str]:
    """n labelled samples of ordinary names: words alone, and two to four of them joined."""
    rng = random.Random(seed)
    words = [w for w in words if w.isascii() and w.isalpha()] or ["value", "name", "index"]
    out = []
    for k in range(n):
        some = rng.choices(words, k=rng.randint(2, 4))
        number = str(rng.randint(0, 2030)) if k % 4 == 3 else ""
        if k % 5 == 4:
            out.append(number_like(rng))
            continue
        out.append((rng.choice(words), "_".join(some).lower(), "-".join(some).lower(), "".join(w.capitalize() for w in some), "/".join(some), "_".join(some).upper(), "".join(some))[k % 7] + number)
    return out


def number_like(rng: random.Random) -> str:
    """A number as texts write them: digits alone, dates, fractions, telephone numbers, codes with a letter or two; or a ruled line."""
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    letter = rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return (digits(rng.randint(1, 16)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(rng.randint(8, 13))}", f"{letter}{digits(rng.randint(1, 4))}", f"{digits(rng.randint(1, 3))}{letter}", f"{letter.upper()}{rng.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ')}-{digits(4)}", rng.choice("-=_+/") * rng.randint(2, 40))[rng.randrange(9)]


def train(secrets: list[str], ordinary: list[str]) -> Model:
    """Both chains, smoothed, as ratios; characters that neither sample has say nothing."""
    logs = []
    for sample in (secrets, ordinary):
        first, after = np.full(256, 0.5), np.full((256, 256), 0.5)
        for s in sample:
            b = np.frombuffer(s.encode("latin-1", "replace"), np.uint8)
            if len(b):
                first[b[0]] += 1
                np.add.at(after, (b[:-1], b[1:]), 1)
        logs.append((np.log(first / first.sum()), np.log(after / after.sum(1, keepdims=True))))
    return Model(*(np.rint((a - b) * SCALE).astype(np.int64) for a, b in zip(*logs, strict=True)))


def fit(docs: DataFrame) -> Model:
    """Trains on random strings and on words of at most SAMPLE_DOCS documents, those with the least hashes of id."""
    ids = docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    words = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("word"))
    sample = [r[0] for r in words.distinct().orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS).collect()]
    return train(random_strings(6000), identifiers(sample, 12_000))


def spans(text: str, model: Model | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if model is not None:
        raw = np.frombuffer(text.encode(), np.uint8)
        starts, ends = model.secrets(raw, np.array([0, len(raw)]))
        if len(starts) and not text.isascii():
            points = np.concatenate([[0], np.cumsum(K.code_points(raw))])
            starts, ends = points[starts], points[ends]
        base, k = sorted((s, e) for s, _, e in found), 0
        reach = np.maximum.accumulate([0, *(e for _, e in base)]).tolist()  # the furthest end of the base spans before each
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            while k < len(base) and base[k][0] < e:
                k += 1
            if reach[k] <= s:
                found.append((s, 3, e))
    return sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def _suspects(column: pa.Array, model: Model) -> np.ndarray:
    """Rows that can have a span: they hold a keyword, an access key's head, a long run of hexadecimal digits, or what the model calls a secret."""
    out = np.zeros(len(column), bool)
    for at, to, buf, offs in K.chunks(column):
        starts, ends, roffs = K.words(buf, offs, ~_HEX)
        out[at:to] = K.per_doc(ends - starts >= 24, roffs) > 0
        out[at + np.searchsorted(offs, model.secrets(buf, offs)[0], "right") - 1] = True
        raw = buf.tobytes()
        lower = K.LOWER[buf].tobytes()
        for text, word in [(raw, b"AKIA"), *((lower, w) for w in _KEYWORDS)]:
            p = text.find(word)
            while p >= 0:
                k = int(np.searchsorted(offs, p, "right")) - 1
                out[at + k] = True
                p = text.find(word, int(offs[k + 1]))
    return out


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    none = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        n, texts = batch.num_rows, batch.column(1)
        if not n:
            continue
        counts, sha, every = np.zeros((4, n), np.int64), [none] * n, [""] * n
        for i in np.flatnonzero(_suspects(texts, model)):
            found = spans(texts[int(i)].as_py() or "", model)
            for _, kind, _ in found:
                counts[kind, i] += 1
            sha[i], every[i] = hashlib.sha256(joined([x for x in found if x[1] < 3]).encode()).hexdigest(), joined(found)
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(sha), pa.array(every)], names=names)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each document: the counts by kind, the base spans' digest and all spans."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(K.frugal(lambda it: _scan(it, model)), _SCHEMA)


def redact(docs: DataFrame, model: Model, mask: str = "[SECRET]") -> DataFrame:
    """The documents with each span, or run of overlapping spans, replaced by the mask; all columns stay."""
    at = docs.columns.index("text")

    def masked(text: str) -> str:
        out, done = [], 0
        for s, _, e in spans(text, model):
            if s >= done:
                out += [text[done:s], mask]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            flags = _suspects(batch.column(at), model)
            new = pa.array([masked(batch.column(at)[int(i)].as_py() or "") for i in np.flatnonzero(flags)], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([pc.replace_with_mask(c, pa.array(flags), new) if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(K.frugal(run), docs.schema)
