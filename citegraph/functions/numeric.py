"""Numeric expressions: Recall@k, dot products, NaN handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recall_at_k(m: Column, n: Column, k: Column | int) -> Column:
    """Chance that a uniform size-k subset of n items holds one of the m matching ones.

    Written as the product of (n-m-i)/(n-i) over i < min(k, n). ``transform`` over a
    1-based sequence is guarded for k = 0, where ``sequence`` would count backwards.
    """
    k = F.lit(k) if isinstance(k, int) else k
    draws = F.least(k, n).cast("int")
    misses = F.aggregate(
        F.sequence(F.lit(1), draws), F.lit(1.0),
        lambda acc, i: acc * F.greatest(n - m - i + 1, F.lit(0)).cast("double") / (n - i + 1).cast("double"),
    )
    return F.when(n <= 0, F.lit(0.0)).when(draws <= 0, F.lit(0.0)).otherwise(F.lit(1.0) - misses)


def dot(left: Column, right: Column) -> Column:
    """Dot product of two vectors, accumulated in double."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def match_count(probs: Column, threshold: float) -> Column:
    """Probabilities strictly above the threshold (NaN never matches)."""
    return F.size(F.filter(probs, lambda p: (p > threshold) & ~F.isnan(p)))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def reaches(value: Column, bound: float) -> Column:
    """Whether a value reaches the bound; NULL and NaN do not."""
    return F.coalesce((value >= bound) & ~F.isnan(value), F.lit(False))
