"""Scalar strata: horizons, cutoff, years, bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import CUTOFF_DATE, FIRST_YEAR

# Histogram edges.
LOG_EDGES = (1, 2, 3, 5, 10, 20, 30, 50, 100, 200, 300, 500, 1000, 2000, 5000, 10_000, 10**9)
CITER_BINS = ((0, 0), (1, 4), (5, 9), (10, 19), (20, 49), (50, 99), (100, 499), (500, 10**9))
HORIZONS = ("0-1y", "2-3y", "4-6y", "7y+")


def horizon(citer_year: Column, seed_year: Column) -> Column:
    """Years between seed and citer; a missing (or zero) citer year counts as the seed's."""
    return F.coalesce(F.nullif(citer_year, F.lit(0)), seed_year) - seed_year


def horizon_bucket(years: Column) -> Column:
    """C03."""
    return (
        F.when(years < 0, "neg").when(years <= 1, "0-1y").when(years <= 3, "2-3y")
        .when(years <= 6, "4-6y").when(years.isNotNull(), "7y+")
    )


def cutoff_stratum(pubdate: Column, year: Column, cutoff: str = CUTOFF_DATE) -> Column:
    """post/pre by ISO date, by year alone without a date, NULL when undecidable."""
    dated = F.nullif(pubdate, F.lit(""))
    by_date = F.when(dated >= cutoff, "post").when(dated < cutoff, "pre")
    by_year = F.when(F.nullif(year, F.lit(0)) < int(cutoff[:4]), "pre")
    return F.coalesce(by_date, by_year)


def year_label(year: Column, first: int = FIRST_YEAR) -> Column:
    """C05."""
    known = F.nullif(year, F.lit(0))
    return F.when(known < first, f"<={first - 1}").otherwise(known.cast("string"))


def log_bin(value: Column) -> Column:
    """Index of the right-open bin (the last one is closed); NULL outside the edges."""
    index = F.when(value == LOG_EDGES[-1], len(LOG_EDGES) - 2)
    for i in range(len(LOG_EDGES) - 1):
        index = index.when((value >= LOG_EDGES[i]) & (value < LOG_EDGES[i + 1]), i)
    return index


def log_bin_labels() -> list[str]:
    """C20: '1', '3-4', '10,000+' style labels, one per bin."""
    labels = []
    for low, high in zip(LOG_EDGES, LOG_EDGES[1:]):
        if high == 10**9:
            labels.append(f"{low:,}+")
        else:
            labels.append(f"{low:,}" if high == low + 1 else f"{low:,}-{high - 1:,}")
    return labels


def short_name(model: Column) -> Column:
    """C17: last path element in lower case."""
    return F.lower(F.element_at(F.split(model, "/"), -1))


def calls_needed(wanted: int, have: Column, per_call: int) -> Column:
    """Model calls that fill the gap."""
    return F.greatest(F.ceil((F.lit(wanted) - have) / per_call), F.lit(0))
