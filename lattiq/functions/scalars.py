"""Column functions: safe arithmetic, NaN handling, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def finite(x: Column) -> Column:
    """The value, or null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """Null on a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio0(a: Column, b: Column) -> Column:
    """0 on a zero denominator."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def f1_of(p: Column, r: Column) -> Column:
    """Null unless both are known and their sum is positive."""
    return F.when(p + r > 0, 2 * p * r / (p + r))


def shown(x: Column, digits: int = 6) -> Column:
    """Rounded for reports; never minus zero."""
    return F.round(x, digits) + F.lit(0.0)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, eps: float = EPS) -> Column:
    """The vector over its length, which counts as ``eps`` at least."""
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(eps)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine with ``eps`` added to both lengths."""
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def bankers(x: Column) -> Column:
    """Rounding with halves to even, as a long."""
    return F.bround(x, 0).cast("long")


def code(namespace: str, seed: int, ident: Column) -> Column:
    """sha256 of namespace, seed and id, parted by zero bytes: a rank that any system can recompute."""
    zero = F.char(F.lit(0))
    return F.sha2(F.concat(F.lit(namespace), zero, F.lit(str(seed)), zero, ident.cast("string")).cast("binary"), 256)
