"""Embedding through a caller's function, a model-free default, and a cache of known vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import materialize

#: Tokens whose place is remembered, by dimension; emptied when full.
_PLACES: dict[int, _Places] = {}
_REMEMBERED = 1 << 18


class _Places(dict):
    """For each token, in UTF-8, the dimension that its md5 names, plus ``dim`` where it counts -1."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: bytes) -> int:
        h = hashlib.md5(token).digest()
        self[token] = place = int.from_bytes(h[:2]) % self.dim + (0 if h[2] < 128 else self.dim)
        return place


def hash_embed(texts: list[str], dim: int = 64) -> np.ndarray:
    """Deterministic vectors without a model: each lower-cased token adds +1 or -1 to the dimension that
    its md5 names; rows are scaled to length one. A text without tokens is the zero vector."""
    # Bytes are split at ASCII white space only, much faster than by a pattern.
    tokens = [(text or "").lower().encode("utf-8", "surrogatepass").split() for text in texts]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
    known = _PLACES.setdefault(dim, _Places(dim))
    if len(known) > _REMEMBERED:
        known.clear()
    place = np.fromiter(map(known.__getitem__, chain.from_iterable(tokens)), np.int64)
    counts = np.bincount(row * 2 * dim + place, minlength=2 * dim * len(texts)).reshape(len(texts), 2, dim) if len(texts) else np.zeros((0, 2, dim))
    out = (counts[:, 0] - counts[:, 1]).astype(np.float64)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1.0)


def unit_vectors(model: Callable, texts: list[str], batch: int = 32) -> np.ndarray:
    """The model's vectors of ``texts``, ``batch`` at a time, L2-normalised."""
    parts = []
    for at in range(0, len(texts), batch):
        v = np.asarray(model([t or "" for t in texts[at : at + batch]]), dtype=np.float64)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        parts.append((v / np.where(norm > 0, norm, 1.0)).astype(np.float32))
    return np.concatenate(parts) if parts else np.zeros((0, 0), np.float32)


def embed(df: DataFrame, column: str = "text", to: str = "embedding", loader: Callable[[], Callable] | None = None, batch: int = 32) -> DataFrame:
    """``df`` with a column of L2-normalised vectors. ``loader`` runs once per Python worker and returns
    the model: a function from a list of texts to an array of vectors."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader() if loader else hash_embed
        for texts in batches:
            yield pd.Series(list(unit_vectors(model, texts.tolist(), batch)), index=texts.index, dtype=object)

    return df.withColumn(to, run(F.col(column)))


def text_hash(column: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(column), F.lit("")), 256)


def missing_vectors(df: DataFrame, cache: DataFrame, column: str = "text", loader: Callable[[], Callable] | None = None) -> DataFrame:
    """text_sha256 and embedding of the texts of ``df`` that ``cache`` lacks, each embedded once however often it occurs."""
    keyed = df.select(text_hash(column).alias("text_sha256"), column)
    fresh = keyed.join(cache.select("text_sha256"), "text_sha256", "left_anti").dropDuplicates(["text_sha256"])
    return embed(fresh, column, "embedding", loader).select("text_sha256", "embedding")


def embed_cached(df: DataFrame, cache: DataFrame, column: str = "text", loader: Callable[[], Callable] | None = None) -> tuple[DataFrame, DataFrame]:
    """(``df`` with vectors, vectors that the cache lacks). ``cache``: text_sha256, embedding. Each new
    text is embedded once however often it occurs; what is made is written before both results use it."""
    fresh = materialize(missing_vectors(df, cache, column, loader), "fresh-vectors")
    known = cache.select("text_sha256", "embedding").unionByName(fresh)
    return df.withColumn("text_sha256", text_hash(column)).join(known, "text_sha256", "left"), fresh


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
