"""Vector geometry as Column expressions (Z1-Z4, Z10, L6). Arrays are cast to double; norms are meant to be made once per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPSILON = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if lengths differ (zip_with pads with null)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def checked_norm(v: Column, epsilon: float = EPSILON) -> Column:
    """The norm; a zero-norm feature raises."""
    n = norm(v)
    return F.when(n <= epsilon, F.raise_error(F.lit("zero-norm feature cannot be normalized")).cast("double")).otherwise(n)


def l2_normalize(v: Column, n: Column) -> Column:
    """v / n for a norm column n."""
    return F.transform(v, lambda x: x / n)


def cosine_distance(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """1 - cos; 0.0 is added so that no -0.0 comes out."""
    return F.lit(1.0) - dot(a, b) / (norm_a * norm_b) + F.lit(0.0)


def normalized_margin(d_n: Column, d_s: Column, epsilon: float = 1e-8) -> Column:
    return (d_s - d_n) / (d_s + d_n + F.lit(epsilon))


def state_score(d_n: Column, d_s: Column, tolerance: float = 1e-6, precision: str = "double") -> Column:
    """A2: 1 if the state is farther by more than the tolerance, 1/2 for a tie, else 0; a NaN or null difference scores 0."""
    if tolerance < 0:
        raise ValueError("tie tolerance must be nonnegative")
    delta = d_s.cast("float") - d_n.cast("float") if precision == "fp32" else d_s - d_n
    return F.when(delta.isNull() | F.isnan(delta), 0.0).when(delta > tolerance, 1.0).when(F.abs(delta) <= tolerance, 0.5).otherwise(0.0)


def hinge(d_n: Column, d_s: Column, margin: float = 0.1) -> Column:
    """max(0, margin + d_n - d_s), for margins in [0, 2]."""
    if not 0 <= margin <= 2:
        raise ValueError("margin must be in [0, 2]")
    return F.greatest(F.lit(0.0), F.lit(margin) + d_n - d_s)


def signed_change(a: Column, b: Column) -> Column:
    """M3: b - a, by coordinate."""
    return F.zip_with(a, b, lambda x, y: y - x)


def distance(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))
