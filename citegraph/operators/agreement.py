"""Correlation and agreement statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from .ranking import quantiles, tied_ranks


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta integral (modified Lentz iteration)."""
    tiny, d = 1e-300, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    c, value = 1.0, d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def two_sided_p(rho: float, n: int) -> float:
    """P value of a correlation under the t distribution with n - 2 degrees of freedom."""
    if n < 3 or math.isnan(rho):
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    if rho == 0:
        return 1.0
    dof = n - 2
    a, b, x = dof / 2, 0.5, 1.0 - rho * rho
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@arrow_udf(DoubleType())
def correlation_p(rho: pa.Array, n: pa.Array) -> pa.Array:
    pairs = zip(rho.to_pylist(), n.to_pylist())
    return pa.array([math.nan if r is None else two_sided_p(r, k) for r, k in pairs], pa.float64())


def spearman(df: DataFrame, x: str, y: str, group: Sequence[str] = (), at_least: int = 10) -> DataFrame:
    """Rank correlation with average ties; groups with fewer than ``at_least`` rows are left out.

    Equal (x, y) rows are counted once, and both axes are ranked in one pass, as rows of the
    axis and its value (two kinds of numbers are compared as doubles). As both rank means
    equal (n + 1) / 2, the moments are summed already centred. Each
    axis' ranks are joined by its value.
    """
    group = list(group)
    kinds = dict(df.dtypes)
    valid = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    same = (lambda c: F.col(c)) if kinds[x] == kinds[y] else (lambda c: F.col(c).cast("double"))
    points = df.where(valid(x) & valid(y)).groupBy(*group, same(x).alias("_x"), same(y).alias("_y")).agg(F.count(F.lit(1)).alias("w"))
    axis = lambda name: F.struct(F.lit(name).alias("axis"), F.col(name).alias("value"))
    long = points.select(*group, "_x", "_y", "w", F.explode(F.array(axis("_x"), axis("_y"))).alias("p")).select(*group, "_x", "_y", "w", "p.*")
    counts = long.groupBy(*group, "axis", "value").agg(F.sum("w").alias("c"))
    ranked = tied_ranks(counts, "value", [*group, "axis"])
    ranked = ranked.select(*group, "axis", "value", (F.col("rank") - (F.col("n_rows") + 1) / 2).alias("r"))
    of = lambda name, r: ranked.where(F.col("axis") == name).select(*group, F.col("value").alias(name), F.col("r").alias(r))
    joined = points.join(of("_x", "rx"), [*group, "_x"]).join(of("_y", "ry"), [*group, "_y"])
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    rho = F.sum(w * rx * ry) / F.sqrt(F.sum(w * rx * rx) * F.sum(w * ry * ry))
    result = joined.groupBy(*group).agg(F.sum("w").alias("n"), rho.alias("rho")).where(F.col("n") >= at_least)
    return result.select(*group, "rho", correlation_p("rho", "n").alias("p"), "n")


def decile_of(df: DataFrame, value: str, n_bins: int = 10, unit: Sequence[str] = ()) -> DataFrame:
    """Bin by percentile edges (not equal counts), as ``decile`` 0..n-1.

    The edges are a single row, attached as a scalar subquery. With ``unit`` they are those of
    one row per unit, however often ``df`` repeats a unit; a unit has one value.
    """
    probs = {f"e{i}": i / n_bins for i in range(n_bins + 1)}
    once = df.groupBy(*unit).agg(F.max(value).alias(value)) if unit else df
    edges = quantiles(once, value, probs).select(F.array(*probs).alias("edges")).scalar()
    reached = sum((F.col("edges")[i] <= F.col(value).cast("double")).cast("int") for i in range(n_bins + 1))
    return (
        df.withColumn("edges", edges)
        .withColumn("decile", F.least(F.greatest(reached - 1, F.lit(0)), F.lit(n_bins - 1)))
        .drop("edges")
    )


def agreement(df: DataFrame, reference: str, predicted: str, positive: Sequence) -> DataFrame:
    """Cohen's kappa over all labels, precision and recall on the ``positive`` set.

    Everything is read off the confusion counts, whose size is the square of the label set.
    """
    confusion = df.where(F.col(reference).isNotNull() & F.col(predicted).isNotNull()).groupBy(
        F.col(reference).alias("ref"), F.col(predicted).alias("pred")
    ).agg(F.count(F.lit(1)).alias("c"))
    sides = confusion.groupBy("ref").agg(F.sum("c").alias("in_ref")).join(
        confusion.groupBy(F.col("pred").alias("ref")).agg(F.sum("c").alias("in_pred")), "ref"
    )
    chance = sides.agg(F.sum(F.col("in_ref").cast("double") * F.col("in_pred"))).scalar()
    ref_hit, pred_hit = F.col("ref").isin(*positive), F.col("pred").isin(*positive)
    count = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0))
    totals = confusion.agg(
        F.sum("c").alias("n"), count(F.col("ref") == F.col("pred")).alias("same"),
        count(ref_hit & pred_hit).alias("tp"), count(pred_hit).alias("n_pred"), count(ref_hit).alias("n_ref"),
    ).withColumn("chance", F.coalesce(chance, F.lit(0.0)))
    n = F.col("n").cast("double")
    by_chance = F.col("chance") / (n * n)
    return totals.select(
        "n", ((F.col("same") / n - by_chance) / (F.lit(1.0) - by_chance)).alias("kappa"),
        (F.col("tp") / F.greatest("n_pred", F.lit(1))).alias("precision"),
        (F.col("tp") / F.greatest("n_ref", F.lit(1))).alias("recall"),
    )
