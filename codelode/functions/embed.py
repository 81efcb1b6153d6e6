"""Embedders: a deterministic one of hashed tokens, and a hook for models."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F

from codelode.functions import text as X


class Embedder(Protocol):
    """dimension; a column of vectors of length 1 for a column of texts; the vector of a query."""

    dimension: int

    def column(self, text: Column) -> Column: ...

    def query(self, text: str) -> list[float]: ...


#: How many tokens a worker remembers the buckets of.
_REMEMBERED = 1 << 17
#: Rows that are counted at a time.
_ROWS = 1_000
_find = re.compile(X.EMBED_TOKEN.encode()).findall


class _Buckets(dict):
    """A token's bucket: the last byte of its MD5, modulo the number of buckets."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        bucket = self[token] = hashlib.md5(token).digest()[-1] % HashEmbedder.dimension
        return bucket


_bucket = _Buckets()


def _counted(texts: pa.Array) -> Iterator[np.ndarray]:
    """Counts of each bucket in texts in lower case, a row for each text and some rows at a time; none for a null."""
    for at in range(0, len(texts), _ROWS):
        part = texts[at : at + _ROWS].to_pylist()
        lengths: list[int] = []

        def found(part: list[bytes | None] = part, lengths: list[int] = lengths) -> Iterator[list[bytes]]:
            for text in part:
                tokens = _find(text) if text else []
                lengths.append(len(tokens))
                yield tokens

        buckets = np.fromiter(map(_bucket.__getitem__, chain.from_iterable(found())), np.int64)
        rows = np.repeat(np.arange(len(part)), lengths)
        yield np.bincount(rows * HashEmbedder.dimension + buckets, minlength=len(part) * HashEmbedder.dimension).reshape(len(part), -1)


class HashEmbedder:
    """Tokens counted in 64 buckets by the last byte of their MD5, scaled to length 1 (no token: zero).

    Tokens are counted in Arrow batches: the same few words make most of a text, so a worker's memory of them spares nearly all digests.
    """

    dimension = 64

    @staticmethod
    def _lowered(text: Column) -> Column:
        return F.lower(text).cast("binary")

    def counts(self, text: Column) -> Column:
        """An array of (bucket, n) of the buckets that a text has tokens in."""

        @F.arrow_udf("array<struct<bucket:int,n:bigint>>")
        def run(texts: pa.Array) -> pa.Array:
            sizes, buckets, n = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for counts in _counted(texts):
                row, bucket = counts.nonzero()
                sizes.append(np.bincount(row, minlength=len(counts)))
                buckets.append(bucket)
                n.append(counts[row, bucket])
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(buckets), pa.int32()), pa.array(np.concatenate(n), pa.int64())], ["bucket", "n"])
            return pa.ListArray.from_arrays(pa.array(np.concatenate(sizes).cumsum(), pa.int32()), pairs)

        return run(self._lowered(text))

    def column(self, text: Column) -> Column:
        @F.arrow_udf("array<float>")
        def run(texts: pa.Array) -> pa.Array:
            out = [np.zeros((0, HashEmbedder.dimension))]
            for counts in _counted(texts):
                norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True).astype(float))
                out.append(counts / np.where(norm > 0, norm, 1.0))
            flat = np.concatenate(out).astype(np.float32).ravel()
            return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, HashEmbedder.dimension), pa.int32()), pa.array(flat))

        return run(self._lowered(text))

    def query_counts(self, text: str) -> list[int]:
        out = [0] * self.dimension
        for t in re.findall(X.EMBED_TOKEN, text.lower(), re.ASCII):
            out[hashlib.md5(t.encode()).digest()[-1] % self.dimension] += 1
        return out

    def query(self, text: str) -> list[float]:
        counts = self.query_counts(text)
        norm = math.sqrt(sum(c * c for c in counts)) or 1.0
        return [c / norm for c in counts]

    def similarity(self, text: Column, query: str) -> Column:
        """Cosine of a column of texts and a query, from integers, so that any engine rounds it alike."""
        own = self.query_counts(query)

        @F.arrow_udf("double")
        def run(texts: pa.Array) -> pa.Array:
            out, asked = [np.zeros(0)], np.array(own)
            for counts in _counted(texts):
                norm = np.sqrt((counts * counts).sum(axis=1).astype(float)) * math.sqrt(float(asked @ asked))
                out.append(counts @ asked / np.where(norm > 0, norm, 1.0))
            return pa.array(np.concatenate(out))

        return run(self._lowered(text))


class ModelEmbedder:
    """Any function from texts to vectors, run in Arrow batches; the model loads once for each worker."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[float]]]], dimension: int) -> None:
        self.load, self.dimension = load, dimension

    @staticmethod
    def _unit(v: list[float]) -> list[float]:
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / norm for x in v]

    def column(self, text: Column) -> Column:
        load, unit = self.load, self._unit

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                yield pd.Series([unit(v) for v in model(batch.tolist())], index=batch.index)

        return run(text)

    def query(self, text: str) -> list[float]:
        return self._unit(self.load()([text])[0])


def named_model(name: str, batch: int = 128) -> ModelEmbedder:
    """A model of the sentence-transformers library by its name; texts go through it in batches of so many."""
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as e:
        raise ValueError(f"the model {name!r} needs the package sentence-transformers") from e
    if batch < 1:
        raise ValueError("a batch holds at least one text")

    def load() -> Callable[[list[str]], list[list[float]]]:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name)
        return lambda texts: model.encode(texts, batch_size=batch, normalize_embeddings=True, convert_to_numpy=True, show_progress_bar=False).tolist()

    return ModelEmbedder(load, int(SentenceTransformer(name).get_sentence_embedding_dimension()))


def dot(vector: Column, query: list[float]) -> Column:
    """The product with a literal vector, a term for each entry that counts, so that whole-stage codegen applies."""
    out = F.lit(0.0)
    for k, q in enumerate(query):
        if q:
            out = out + vector[k].cast("double") * F.lit(float(q))
    return out
