"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def normalized(v: Column) -> Column:
    n = norm(v)
    return F.when(n == 0, as_double(v)).otherwise(F.transform(as_double(v), lambda x: x / n))


def sanitized(v: Column, dims: int | None = None) -> Column:
    """NaN and infinite components become 0; a vector of the wrong length fails the job."""
    clean = F.transform(v, lambda x: F.when(F.isnan(x) | (F.abs(x.cast("double")) == float("inf")), 0).otherwise(x))
    return clean if dims is None else F.when(F.size(v) == dims, clean).otherwise(F.raise_error(F.concat(F.lit(f"expected {dims} dimensions, found "), F.size(v).cast("string"))))


def similarity_of_distance(distance: Column) -> Column:
    return 1 / (1 + F.greatest(distance, F.lit(0.0)))


def hashed_bucket(token: Column, dims: int) -> Column:
    """The first four bytes of a token's md5, little endian, modulo ``dims``."""
    h = F.md5(token)
    swapped = F.concat(h.substr(7, 2), h.substr(5, 2), h.substr(3, 2), h.substr(1, 2))
    return (F.conv(swapped, 16, 10).cast("long") % dims).cast("int")
