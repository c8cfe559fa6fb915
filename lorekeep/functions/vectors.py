"""Vector expressions over ARRAY<FLOAT> columns."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine of the angle; null when either vector is zero."""
    return dot(left, right) / F.nullif(l2_norm(left) * l2_norm(right), F.lit(0.0))


def similarity_from_distance(distance: Column) -> Column:
    return F.lit(1.0) - distance


def _numbers(tokens: list[bytes]) -> np.ndarray:
    """The first 8 hex digits of each token's md5."""
    digests = b"".join([hashlib.md5(token).digest() for token in tokens])
    return np.frombuffer(digests, ">u4")[::4].astype(np.int64)


def _each(words: pa.StringArray) -> list[bytes]:
    """The words as bytes; taken from their buffer, as Arrow's own values take several times longer."""
    _, bounds, data = words.buffers()
    ends = np.frombuffer(bounds, np.int32)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else []
    whole = data.to_pybytes() if data else b""
    return [whole[start:end] for start, end in zip(ends, ends[1:])]


def hash_vectors(texts: Sequence[str | None], dim: int = 256) -> np.ndarray:
    """A unit vector per text: how often each bucket is hit by its lower-cased tokens.

    A token's bucket is its number modulo ``dim``. A text without tokens has the zero vector.
    """
    # Arrow splits at runs of the six white-space characters of ASCII, which may leave empty strings at the ends.
    split = pc.ascii_split_whitespace(pa.array([(text or "").lower() for text in texts], pa.string()))
    tokens = split.flatten().dictionary_encode()
    # Every distinct token of the batch is hashed once; the rest is counting.
    distinct = _each(tokens.dictionary)
    buckets = np.where(np.array([len(token) for token in distinct], np.int64) > 0, _numbers(distinct) % dim, -1)[tokens.indices.to_numpy()]
    rows = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy())
    cells = (rows * dim + buckets)[buckets >= 0]
    counts = np.bincount(cells, minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float64)
    norms = np.linalg.norm(counts, axis=1, keepdims=True)
    return np.divide(counts, norms, out=counts, where=norms > 0).astype(np.float32)


def vector_lists(vectors: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    rows, dim = vectors.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * dim), pa.array(vectors.ravel()))
