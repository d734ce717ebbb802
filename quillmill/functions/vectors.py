"""Vectors: a hash embedder for tests, cosine distance, and the plug-in point for models."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, and (in _place) which place and sign its digest stands for.
_WORD = re.compile(r"\w+")
DIM = 256


class Embedder(Protocol):
    """What a model must offer; built once in each Python worker by the factory given to :func:`embed`."""

    dim: int

    def passages(self, texts: list[str]) -> np.ndarray: ...

    def query(self, text: str) -> np.ndarray: ...


class HashEmbedder:
    """Words hashed to signed places, scaled to length 1; a text without words is the zero vector."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim = dim
        self._places: dict[str, tuple[int, float]] = {}

    def _place(self, word: str) -> tuple[int, float]:
        at = self._places.get(word)
        if at is None:
            digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
            at = self._places[word] = (int.from_bytes(digest[:4], "little") % self.dim, 1.0 if digest[4] & 1 else -1.0)
        return at

    def query(self, text: str) -> np.ndarray:
        vector = np.zeros(self.dim, np.float32)
        for word in _WORD.findall((text or "").lower()):
            i, sign = self._place(word)
            vector[i] += sign
        length = float(np.linalg.norm(vector))
        return vector / length if length else vector

    def passages(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            row += self.query(text)
        return out


def embed(df: DataFrame, text: str, factory: Callable[[], Embedder] = HashEmbedder, into: str = "embedding", batch: int = 32, queries: bool = False) -> DataFrame:
    """``df`` with the embedding of its column ``text`` (null counts as empty); the model is loaded once for each task.

    ``queries`` embeds the texts as queries, which some models tell from passages.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != into) + f", `{into}` array<float>"
    names = [c for c in df.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            texts = [x or "" for x in b.column(text).to_pylist()]
            some = (lambda x: np.stack([model.query(t) for t in x])) if queries else model.passages
            parts = [some(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            matrix = np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, model.dim), np.float32)
            flat = pa.array(matrix.ravel(), pa.float32())
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * matrix.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], vectors], names=[*names, into])

    return df.mapInArrow(run, schema)


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b) in double; null where either vector is null, zero or of another length."""
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
