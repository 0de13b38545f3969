"""Splitting of hot groups.

Plain equi-joins are left to adaptive execution, which splits skewed join partitions by
itself. The helpers here serve the operators that gather a group in one place: they cut a
group into pieces of bounded size first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_LIST_ROWS = 20_000


def hot_groups(df: DataFrame, keys: list[str], rows: int) -> DataFrame | None:
    """Groups with more than ``rows`` rows, with the number of pieces each is cut into.

    The count reads the key columns only and is combined map-side. The list is fetched up
    to ``HOT_LIST_ROWS`` entries: a list that fits is proven small and comes back as a
    local table with a broadcast hint; a longer one comes back as the lazy table, joined
    by whatever strategy its measured size allows. ``None`` means no group is hot.
    """
    counted = (
        df.groupBy(*keys).count().where(F.col("count") > rows)
        .select(*keys, F.ceil(F.col("count") / rows).cast("int").alias("n_pieces"))
    )
    found = counted.limit(HOT_LIST_ROWS + 1).collect()
    if not found:
        return None
    if len(found) > HOT_LIST_ROWS:
        return counted
    return F.broadcast(df.sparkSession.createDataFrame(found, counted.schema))


def with_pieces(df: DataFrame, keys: list[str], spread: Column, rows: int, hot: DataFrame | None) -> DataFrame:
    """Add ``piece``: 0 for ordinary groups, an even spread over the pieces of a hot one."""
    if hot is None:
        return df.withColumn("piece", F.lit(0))
    return (
        df.join(hot, keys, "left")
        .withColumn("piece", F.coalesce(F.pmod(F.xxhash64(spread), F.col("n_pieces")).cast("int"), F.lit(0)))
        .drop("n_pieces")
    )


def copy_per_piece(df: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """Repeat each row once per piece of its group, to meet the pieces of the other side."""
    if hot is None:
        return df.withColumn("piece", F.lit(0))
    return (
        df.join(hot, keys, "left")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n_pieces"), F.lit(1)) - 1)))
        .drop("n_pieces")
    )
