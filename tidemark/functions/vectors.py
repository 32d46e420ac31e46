"""Vectors as arrays: cosine, norm, the default hashing embedding."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let, words

EMBED_ROWS = 1000  # texts whose words a task counts at a time


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null when one side has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalised(a: Column) -> Column:
    return let(a, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))))


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Normalised word counts per bucket; null for a text without words. The bucket of a word is the first 8 hex digits of
    its md5, modulo ``dim``. Spark cuts the words; a batch of texts is counted at once, every different word hashed once."""
    rows_at_once = EMBED_ROWS

    @F.arrow_udf("array<double>")
    def counted(found: pa.Array) -> pa.Array:
        import hashlib

        import numpy as np
        import pyarrow as pa

        def part(rows):
            words = rows.flatten().dictionary_encode()
            digests = (hashlib.md5(w.encode(), usedforsecurity=False).digest() for w in words.dictionary.to_pylist())
            bucket = np.fromiter((int.from_bytes(d[:4], "big") % dim for d in digests), np.int64)
            at = np.repeat(np.arange(len(rows)) * dim, rows.value_lengths().fill_null(0).to_numpy())
            counts = np.bincount(at + bucket[words.indices.to_numpy()], minlength=len(rows) * dim).reshape(len(rows), dim)
            length = np.sqrt((counts * counts).sum(axis=1))
            some = length > 0
            vectors = counts[some] / length[some, None]
            ends = np.cumsum(np.r_[0, some * dim]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()), mask=pa.array(~some))

        slices = [part(found.slice(low, rows_at_once)) for low in range(0, len(found), rows_at_once)]
        return pa.concat_arrays(slices) if slices else pa.array([], pa.list_(pa.float64()))

    return counted(words(text))


def has_dimension(vector: Column, dim: int) -> Column:
    """False for a missing, empty or wrongly sized vector."""
    return F.coalesce(F.size(vector) == dim, F.lit(False))
