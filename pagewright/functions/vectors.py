"""Vector expressions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """-1 for vectors of different lengths and for zero vectors."""
    return F.when((F.size(a) != F.size(b)) | (norm(a) == 0) | (norm(b) == 0), -1.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, 0.0).otherwise(x / n))


def hashed(text: Column, dimensions: int) -> Column:
    """A stand-in embedder: bytes of the text's hash scaled to -1..1, made unit length."""
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)),
        lambda i: F.conv(F.substring(F.sha2(F.concat_ws(":", text, F.floor(i / 32).cast("string")), 256), 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1,
    )
    return unit(raw)
