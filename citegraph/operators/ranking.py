"""Exact order statistics without a single-task sort.

Every operator here first collapses equal values to one counted row, then cuts the rows at
splitters, values of a sample of those rows, into about ``SLICES`` slices of even size. Prefix
sums over the slice counts (at most ``SLICES`` rows per group) say how many rows precede a
slice; a window inside the slice does the rest. A group holding most of the data is therefore
ranked by many tasks, however its values are spread, and nothing is approximated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_slice

# A power of two, so that halving finds a value's slice.
SLICES = 1024
# Rows of the sample per slice; a slice holds a few times its share of the rows at most.
PER_SLICE = 8


def value_counts(df: DataFrame, value: str, group: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per (group, value) with its row count ``c``."""
    measure = F.sum(weight) if weight else F.count(F.lit(1))
    return df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(measure.alias("c"))


def splitters(counts: DataFrame, value: str) -> Column:
    """Scalar subquery: SLICES - 1 ascending cut points as an array, from a sample of the rows.

    The sample takes the rows whose hash is divisible by a power of two that leaves about
    ``PER_SLICE`` rows per slice, so its size is bounded. Readers of the same rows, and a task
    that is run again, find the same cut points; a sketch with random compaction would let two
    branches of one plan disagree on the slices.
    """
    x = F.col(value).cast("double")
    # Some 8,192 to 16,384 rows of any number stay.
    level = F.floor(F.log2(F.greatest(F.count(F.lit(1)) / float(SLICES * PER_SLICE), F.lit(1.0)))).cast("int")
    rarity = counts.agg(level.alias("level")).scalar()
    keys = [c for c in counts.columns if c != "c"]
    sample = counts.select(x.alias("x"), F.xxhash64(*keys).alias("h"), rarity.alias("level")).where(
        F.pmod("h", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))) == 0)
    points = sample.agg(F.sort_array(F.collect_list("x")).alias("all"))
    n = F.size("all")
    cut = lambda i: F.get("all", F.floor(i * n / float(SLICES)).cast("int"))
    return points.select(F.transform(F.sequence(F.lit(1), F.lit(SLICES - 1)), cut).alias("cuts")).scalar()


def _sliced(counts: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Attach the slice number, the number of splitters not above the value, and deal the rows by group and slice.

    All groups share the splitters, which come from one scalar subquery: a row of a hot
    group then needs no join to learn its group's range. Each halving step is a projection of
    its own, so it is computed once, in generated code. Slice counts and windows read the same exchange.
    """
    placed = counts.withColumn("cuts", splitters(counts, value)).withColumn("slice", F.lit(0))
    step = SLICES // 2
    while step:
        reached = F.get("cuts", F.col("slice") + (step - 1)) <= F.col(value).cast("double")
        placed = placed.withColumn("slice", F.col("slice") + F.when(reached, step).otherwise(0))
        step //= 2
    return placed.drop("cuts").repartition(*group, "slice")


def _slice_offsets(sliced: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Rows before each slice and the group's totals; the windows see at most ``SLICES`` rows per group."""
    per_slice = sliced.groupBy(*group, "slice").agg(
        F.sum("c").alias("in_slice"), F.sum(F.col(value).cast("double") * F.col("c")).alias("sum_slice")
    )
    earlier = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    return per_slice.select(
        *group, "slice", "in_slice", F.coalesce(F.sum("in_slice").over(earlier), F.lit(0)).alias("before_slice"),
        F.sum("in_slice").over(whole).alias("n_rows"), F.sum("sum_slice").over(whole).alias("total"),
    )


def _within(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Rows of the same slice with a smaller value."""
    earlier = (
        Window.partitionBy(*group, "slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    return df.withColumn("before_within", F.coalesce(F.sum("c").over(earlier), F.lit(0)))


def cumulative(counts: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Value counts plus ``before`` (rows with a smaller value), ``n_rows`` and ``total``.

    The window and the join that follows share one shuffle by (group, slice).
    """
    sliced = _sliced(counts, value, group)
    placed = _within(sliced, value, group).join(_slice_offsets(sliced, value, group), [*group, "slice"])
    return placed.select(
        *counts.columns, (F.col("before_slice") + F.col("before_within")).alias("before"), "n_rows", "total"
    )


def _rank_positions(kind: str, p: float, n: Column) -> tuple[Column, Column, Column]:
    """0-based lower and upper order statistic and the weight of the upper one."""
    zero = F.lit(0.0)
    if kind == "linear":
        h = F.lit(p) * (n - 1)
        return F.floor(h).cast("long"), F.ceil(h).cast("long"), h - F.floor(h)
    if kind == "disc":
        at = F.greatest(F.ceil(F.lit(p) * n) - 1, F.lit(0)).cast("long")
        return at, at, zero
    if kind == "nearest":
        at = F.bround(F.lit(p) * (n - 1)).cast("long")
        return at, at, zero
    raise ValueError(f"unknown quantile kind {kind!r}")


def quantiles(
    df: DataFrame, value: str, probs: dict[str, float], group: Sequence[str] = (), kind: str = "linear",
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles, one row per group with ``n``, ``total`` and one column per prob.

    ``linear`` interpolates, ``disc`` takes the smallest value whose cumulative share
    reaches p, ``nearest`` rounds the position half to even. Only slices that hold a
    wanted position are sorted. No values give no row.
    """
    counts = value_counts(df, value, group, weight)
    sliced = _sliced(counts, value, group)
    wanted = F.lit(False)
    for p in probs.values():
        for at in _rank_positions(kind, p, F.col("n_rows"))[:2]:
            wanted |= (F.col("before_slice") <= at) & (at < F.col("before_slice") + F.col("in_slice"))
    offsets = _slice_offsets(sliced, value, group).where(wanted).drop("in_slice")
    ranked = _within(sliced.join(offsets, [*group, "slice"]), value, group).withColumn(
        "before", F.col("before_slice") + F.col("before_within")
    )
    n = F.col("n_rows")
    outputs = []
    for name, p in probs.items():
        low_at, high_at, share = _rank_positions(kind, p, n)
        here = F.col("before"), F.col("before") + F.col("c")
        low = F.max(F.when((here[0] <= low_at) & (low_at < here[1]), F.col(value)))
        if kind == "linear":
            high = F.max(F.when((here[0] <= high_at) & (high_at < here[1]), F.col(value)))
            low, high = low.cast("double"), high.cast("double")
            outputs.append((low + (high - low) * F.max(share)).alias(name))
        else:
            outputs.append(low.alias(name))
    found = ranked.groupBy(*group).agg(F.max("n_rows").alias("n"), F.max("total").alias("total"), *outputs)
    return found.where(F.col("n").isNotNull())


def summary(
    df: DataFrame, value: str, group: Sequence[str] = (), percents: Sequence[int] = (10, 25, 50, 75, 90),
    weight: str | None = None,
) -> DataFrame:
    """A10: n, mean and interpolated percentiles; NaN and NULL values are left out."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    result = quantiles(kept, value, {f"p{p}": p / 100 for p in percents}, group, "linear", weight)
    return result.select(
        *group, "n", (F.col("total") / F.col("n")).alias("mean"), *[f"p{p}" for p in percents]
    )


def nearest_rank_summary(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Nearest-rank p10..p90, maximum and the mean to two decimals."""
    probs = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "max": 1.0}
    return quantiles(df, value, probs, group, "nearest").select(
        *group, *probs, F.bround(F.col("total") / F.col("n"), 2).alias("mean")
    )


def dense_index(df: DataFrame, order: str) -> DataFrame:
    """0-based position of each row by a unique numeric column, as ``row_index``."""
    counts = df.select(order).withColumn("c", F.lit(1).cast("long"))
    ranked = cumulative(counts, order).select(order, F.col("before").alias("row_index"), "n_rows")
    return df.join(ranked, order)


def tied_ranks(counts: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Average rank of each distinct value (1-based), as ``rank``."""
    return cumulative(counts, value, group).withColumn("rank", F.col("before") + (F.col("c") + 1) / 2)


def cyclic_successor(ids: DataFrame, id_col: str, digest: str) -> DataFrame:
    """Each id with the next id in digest order; the last one gets the first.

    Digests are uniform, so their leading digits cut the cycle into at most 4,096 even
    arcs. ``lead`` runs inside an arc; the last id of an arc takes the first id of the
    following one, looked up in a table of at most 4,096 rows.
    """
    arcs = ids.select(id_col, digest, hash_slice(F.col(digest)).alias("arc"))
    order = Window.partitionBy("arc").orderBy(digest, id_col)
    inner = arcs.withColumn("inside", F.lead(id_col).over(order))
    firsts = arcs.groupBy("arc").agg(F.min(F.struct(digest, id_col)).alias("head"))
    cycle = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select(
        "arc",
        F.coalesce(
            F.lead(f"head.{id_col}").over(Window.orderBy("arc")), F.first(f"head.{id_col}").over(cycle)
        ).alias("outside"),
    )
    # At most 4,096 arcs exist by construction.
    return inner.join(F.broadcast(following), "arc").select(
        id_col, F.coalesce("inside", "outside").alias("donor_id")
    )
