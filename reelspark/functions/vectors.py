"""Vectors and bit hashes as column expressions; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def face_distance(a: Column, b: Column, assumed: bool = False) -> Column:
    """0 if identity is assumed, 9 if a vector is missing, else one minus the cosine with norms floored."""
    if assumed:
        return F.lit(0.0)
    floor = lambda v: F.greatest(norm(v), F.lit(1e-6))
    return F.when(a.isNull() | b.isNull(), F.lit(9.0)).otherwise(1 - dot(a, b) / (floor(a) * floor(b)))


def bound(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body or its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(a: Column, eps: float = 1e-10, weight: float = 1.0) -> Column:
    """The vector over its norm, times a weight; the norm is computed once, not for each coordinate."""
    return bound(F.struct(a.alias("v"), (norm(a) + eps).alias("n")), lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"] * weight))


def mixed(a: Column, b: Column, weight_a: float, weight_b: float) -> Column:
    """Weighted sum of two unit vectors, the shorter one padded with zeros, of norm 1; null if both are."""
    part = lambda v, w: F.coalesce(unit(v, 1e-6, w), F.array().cast("array<double>"))
    both = F.zip_with(part(a, weight_a), part(b, weight_b), lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    return bound(both, lambda v: F.when(F.size(v) > 0, unit(v, 1e-6)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_hash(v: str) -> Column:
    """63 bits: whether each of the first coordinates is positive."""
    return F.expr(f"aggregate(sequence(0, 62), 0L, (h, i) -> h | if({v}[i] > 0, shiftleft(1L, i), 0L))")


def cosine_distance(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return 1 - cosine(a, b, eps)


def plain_distance(a: Column, b: Column) -> Column:
    """One minus the cosine without a floor under the norms; null where a vector has no length."""
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def hash_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    return 1 - hamming(a, b) / bits


def total(rows: Column) -> Column:
    """The sum of an array of vectors of one length."""
    return F.aggregate(F.slice(rows, 2, 1 << 30), F.transform(F.get(rows, F.lit(0)), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
