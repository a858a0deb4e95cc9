"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null for a zero vector, which is similar to nothing."""
    return F.try_divide(dot(a, b), magnitude(a) * magnitude(b))


def hash_embedding(text: Column, dims: int) -> Column:
    """A deterministic unit vector from the bytes of a text's SHA-256."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    byte = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: byte(i) / 255.0 * 2 - 1)
    return F.get(F.transform(F.array(raw), lambda v: _unit(v)), F.lit(0))


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.get(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: (x / n).cast("float"))), F.lit(0))
