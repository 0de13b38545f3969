"""Plot tables: the numbers behind the figures, one small table each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import INTENT_NAMES, intent_name
from ..functions.strata import LOG_EDGES, log_bin, log_bin_labels
from ..operators.ranking import quantiles, value_counts

QUANTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def zero_filled(counts: DataFrame, key: str, last: int | Column, first: int = 0) -> DataFrame:
    """Counts for every integer ``first``..``last``, zero where nothing was counted."""
    spark = counts.sparkSession
    last = F.lit(last) if isinstance(last, int) else last
    axis = spark.range(1).select(F.explode(F.sequence(F.lit(first), last.cast("int"))).alias(key))
    return axis.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def binned(df: DataFrame, bin_no: Column, last: int | Column, first: int = 0, key: str = "bin") -> DataFrame:
    counts = df.select(bin_no.cast("int").alias(key)).where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n")
    )
    return zero_filled(counts, key, last, first)


def year_bars(df: DataFrame, year: str, start: int = 1990) -> DataFrame:
    """One pooled bar before ``start``, then one bar per year up to the last one."""
    known = df.where(F.col(year).isNotNull())
    latest = known.agg(F.greatest(F.max(year), F.lit(start))).scalar()
    bars = binned(known, F.greatest(F.col(year), F.lit(start - 1)), latest, start - 1, "year")
    label = F.when(F.col("year") < start, f"<{start}").otherwise(F.col("year").cast("string"))
    return bars.select(label.alias("label"), "n")


def log_histogram(df: DataFrame, value: str) -> DataFrame:
    """Counts per logarithmic bin, empty bins at both ends cut off."""
    labels = F.array(*[F.lit(x) for x in log_bin_labels()])
    bars = binned(df, log_bin(F.col(value)), len(LOG_EDGES) - 2)
    # Sixteen bins.
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    used = F.when(F.col("n") > 0, F.col("bin"))
    return (
        bars.withColumn("first", F.min(used).over(whole)).withColumn("last", F.max(used).over(whole))
        .where(F.col("bin").between(F.col("first"), F.col("last")))
        .select("bin", F.get(labels, F.col("bin")).alias("label"), "n")
    )


def histogram_note(df: DataFrame, value: str) -> DataFrame:
    """Median of the values and the fullest bin (the first one among equals)."""
    bars = log_histogram(df, value)
    fullest = bars.agg(F.max_by("label", F.struct("n", -F.col("bin"))).alias("label")).scalar()
    return quantiles(df, value, {"median": 0.5}).select("n", "median", fullest.alias("fullest_bin"))


def concentration(seed_sizes: DataFrame, size: str = "n_citers") -> DataFrame:
    """The curve's corner points, seeds ranked by descending citer count.

    Between two corners all seeds have the same count, so the curve is a straight line
    there. P pairs allow at most sqrt(2 P) different counts, which bounds the window.
    """
    sizes = value_counts(seed_sizes, size)
    down = Window.orderBy(F.desc(size)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    cum_seeds, cum_pairs = F.sum("c").over(down), F.sum(F.col(size) * F.col("c")).over(down)
    return sizes.select(
        F.col(size).alias("n_citers"), F.col("c").alias("n_seeds"), cum_seeds.alias("cum_seeds"),
        cum_pairs.alias("cum_pairs"),
        (F.lit(100.0) * cum_seeds / F.sum("c").over(whole)).alias("seed_share"),
        (F.lit(100.0) * cum_pairs / F.sum(F.col(size) * F.col("c")).over(whole)).alias("pair_share"),
    )


def top_shares(seed_sizes: DataFrame, percents: tuple[int, ...] = (1, 10), size: str = "n_citers") -> DataFrame:
    """Pair share of the largest 1 % and 10 % of the seeds, at least one seed."""
    corners = concentration(seed_sizes, size)
    totals = Window.partitionBy()
    n_seeds, n_pairs = F.max("cum_seeds").over(totals), F.max("cum_pairs").over(totals)
    pct = F.explode(F.array(*[F.lit(p) for p in percents])).alias("pct")
    rows = corners.select("*", n_seeds.alias("all_seeds"), n_pairs.alias("all_pairs")).select("*", pct)
    k = F.greatest(F.lit(1), F.bround(F.col("all_seeds") * F.col("pct") / 100).cast("long"))
    before = F.col("cum_seeds") - F.col("n_seeds")
    pairs = F.col("cum_pairs") - (F.col("cum_seeds") - k) * F.col("n_citers")
    return rows.where((before < k) & (k <= F.col("cum_seeds"))).select(
        "pct", k.alias("top_seeds"), (F.lit(100.0) * pairs / F.col("all_pairs")).alias("pair_share")
    )


def horizon_bars(df: DataFrame, years: str = "horizon", fold: int = 16) -> DataFrame:
    """Years 0..15 and a pooled last bar."""
    known = df.where(F.col(years) >= 0)
    bars = binned(known, F.least(F.col(years), F.lit(fold)), fold)
    label = F.when(F.col("bin") == fold, f"{fold}+").otherwise(F.col("bin").cast("string"))
    return bars.select("bin", label.alias("label"), "n")


def horizon_note(df: DataFrame, years: str = "horizon") -> DataFrame:
    return quantiles(df, years, {"median": 0.5, "p90": 0.9}).drop("total")


def length_histogram(df: DataFrame, length: str, low: int = 200, high: int = 5000, width: int = 100) -> DataFrame:
    """Fixed-width bins over [low, high]; the last one includes its upper edge."""
    last = (high - low) // width - 1
    inside = df.where(F.col(length).between(low, high))
    bars = binned(inside, F.least(F.floor((F.col(length) - low) / width), F.lit(last)), last)
    return bars.select((F.col("bin") * width + low).alias("bin_start"), "n")


def field_shares(df: DataFrame, fields: str = "fields", top: int = 10) -> DataFrame:
    """Most frequent fields as a share of pairs; a field counts once per pair."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = df.select(F.explode(F.array_distinct(fields)).alias("field")).groupBy("field").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.orderBy(F.desc("n"), "field").limit(top).select(
        "field", "n", (F.lit(100.0) * F.col("n") / total).alias("share")
    )


def intent_groups(pairs: DataFrame, sim: str = "sim", null_sim: str = "null_sim", code: str = "code") -> DataFrame:
    """Similarity quantiles per intent combination and the share above the null's p95.

    The reference row (code -1) describes the null similarities; by construction 5 % of
    them lie above their own 95th percentile.
    """
    p95 = quantiles(pairs, null_sim, {"p95": 0.95}).select("p95").scalar()
    above = pairs.groupBy(code).agg(F.avg((F.col(sim) > p95).cast("double")).alias("above"))
    groups = quantiles(pairs, sim, QUANTILES, [code]).drop("total").join(above, code).select(
        code, intent_name(F.col(code)).alias("name"), "n", *QUANTILES, (F.col("above") * 100).alias("above")
    )
    null = quantiles(pairs, null_sim, QUANTILES).select(
        F.lit(-1).alias(code), F.lit("random other seed").alias("name"), "n", *QUANTILES, F.lit(5.0).alias("above")
    )
    assert len(INTENT_NAMES) == 8
    return groups.unionByName(null).orderBy(F.desc("p50"), code)


def density(pairs: DataFrame, value: str, low: Column, high: Column, bins: int = 60) -> DataFrame:
    """Density over ``bins`` equal bins of [low, high]; values outside are not counted."""
    rows = pairs.select(F.col(value).cast("double").alias("x"), low.alias("lo"), high.alias("hi")).where(
        F.col("x").between(F.col("lo"), F.col("hi"))
    )
    number = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = rows.groupBy(number.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi")
    )
    whole = Window.partitionBy()
    width = (F.max("hi").over(whole) - F.max("lo").over(whole)) / bins
    densities = counts.select("bin", "n", (F.col("n") / (F.sum("n").over(whole) * width)).alias("density"))
    axis = pairs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return axis.join(densities, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("density", F.lit(0.0)).alias("density")
    )
