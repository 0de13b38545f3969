"""Helpers for tasks that read sorted groups, and connected components by joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames cut anew so that rows of one key, adjacent in the input, never lie in two of them."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
        first = len(frame) - int(np.argmin(last[::-1])) if not last.all() else 0
        if first == 0 and held and (held[-1][keys].iloc[-1] == frame[keys].iloc[0]).all():
            held.append(frame)
            continue
        if first:
            yield pd.concat([*held, frame.iloc[:first]], ignore_index=True)
        elif held:
            yield pd.concat(held, ignore_index=True)
        held = [frame.iloc[first:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining positions a[k] and b[k]; each set of joined labels becomes its smallest."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): the smallest node of each connected component, for nodes with an edge (a, b).

    Large-star and small-star steps alternate: in the first each node links its larger
    neighbours to its smallest, in the second it links its smaller ones and itself to that.
    A step aggregates with map-side combination and never gathers neighbours; each is stored
    once, and the loop ends when a step leaves the number and the sum of edges unchanged.
    """
    small = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = small.unionByName(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(lowest, "a").select(F.col("b").alias("x"), "a", "m")
        moved = star.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(star.select("a", F.col("m").alias("b")))
        small = materialise(moved.where("a <> b").distinct())
        state = small.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1000003).alias("h")).first()
        if state == before:
            break
        before = state
    return small.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
        small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))
