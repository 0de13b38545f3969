"""Description of a corpus and of the benchmark's pairs and target sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import intent_key, shares_member
from ..functions.strata import CITER_BINS, HORIZONS, horizon, horizon_bucket
from ..operators import vectors as V
from ..operators.ranking import cumulative, summary, value_counts



# ---- corpus level

def corpus_links(edges: DataFrame, seeds: DataFrame, citers: DataFrame, year_min: int, year_max: int) -> DataFrame:
    """Edges of seeds inside the year window with the citer columns used below."""
    seed_side = seeds.where(F.col("year").between(year_min, year_max)).select(
        F.col("corpusid").alias("seed_id"), F.col("s2fieldsofstudy").alias("seed_fields")
    )
    citer_side = citers.select(
        F.col("corpusid").alias("citer_id"), F.col("abstract").isNotNull().alias("has_abstract"),
        F.col("acl_id").isNotNull().alias("is_acl"), "venue", F.col("s2fieldsofstudy").alias("fields"),
    )
    links = edges.select(F.col("citedcorpusid").alias("seed_id"), F.col("citingcorpusid").alias("citer_id"))
    return links.join(seed_side, "seed_id").join(citer_side, "citer_id")


def edge_counts(links: DataFrame) -> DataFrame:
    """Edges, edges with abstract, share of identified citers and of shared fields."""
    texted = F.col("has_abstract")
    return links.agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum(texted.cast("long")).alias("n_edges_with_abstract"),
        F.avg(F.when(texted, F.col("is_acl").cast("double"))).alias("citer_is_acl_frac"),
        F.avg(F.when(texted, shares_member(F.col("fields"), F.col("seed_fields")).cast("double")))
        .alias("citer_same_field_frac"),
    )


def citers_with_abstract(links: DataFrame, seeds: DataFrame, year_min: int, year_max: int) -> DataFrame:
    """Per seed of the window the citers that have an abstract; seeds without edges count 0."""
    counted = links.groupBy("seed_id").agg(F.sum(F.col("has_abstract").cast("long")).alias("n"))
    window = seeds.where(F.col("year").between(year_min, year_max)).select(F.col("corpusid").alias("seed_id"))
    return window.join(counted, "seed_id", "left").select("seed_id", F.coalesce("n", F.lit(0)).alias("n"))


def citer_bins(per_seed: DataFrame) -> DataFrame:
    """Seeds per closed bin, empty bins included; all bins are sums of one pass."""
    names = [f"{lo}-{'inf' if hi >= 10**9 else hi}" for lo, hi in CITER_BINS]
    sums = [F.sum(F.col("n").between(lo, hi).cast("long")) for lo, hi in CITER_BINS]
    row = per_seed.agg(F.array(*[F.struct(F.lit(n).alias("bin"), s.alias("n_seeds")) for n, s in zip(names, sums)]).alias("b"))
    return row.select(F.inline("b"))


def top_fields(links: DataFrame, top: int = 15) -> DataFrame:
    """A08."""
    counts = links.where("has_abstract").select(F.explode("fields").alias("field")).groupBy("field").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.orderBy(F.desc("n"), "field").limit(top)


def top_venues(links: DataFrame, top: int = 20) -> DataFrame:
    """Venues of citers that carry no id themselves."""
    kept = links.where(F.col("has_abstract") & ~F.col("is_acl") & F.col("venue").isNotNull())
    return kept.groupBy("venue").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "venue").limit(top)


# ---- pairs

def pair_covariates(rows: DataFrame) -> DataFrame:
    """From benchmark rows (seed columns plus the citer struct)."""
    years = horizon(F.col("citer.year"), F.col("seed_year"))
    return rows.select(
        "seed_id", F.col("citer.id").alias("citer_id"),
        shares_member(F.col("citer.fields"), F.col("seed_fields")).alias("same_field"),
        F.col("citer.acl_id").isNotNull().alias("citer_acl"),
        years.alias("horizon"), horizon_bucket(years).alias("horizon_bucket"),
        F.col("citer.isinfluential").alias("influential"), intent_key(F.col("citer.intents")).alias("intent"),
        F.coalesce("citer.citationcount", F.lit(0)).alias("citer_citations"),
    )


def covariate_shares(pairs: DataFrame) -> DataFrame:
    """A07."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_frac")
    return pairs.agg(share("same_field"), share("citer_acl"), share("influential"))


def top_intents(pairs: DataFrame, top: int = 12) -> DataFrame:
    """A12."""
    return pairs.groupBy("intent").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "intent").limit(top)


def similarity_by_stratum(pairs: DataFrame, sim: str = "sim", intents: int = 6) -> DataFrame:
    """Summary of ``sim`` over all pairs, covariates, horizons and the commonest intents.

    A pair belongs to several strata; it is expanded once and all strata are summarised together.
    """
    common = top_intents(pairs, intents).select(F.col("intent"), F.lit(True).alias("common"))
    label = lambda c: F.concat(F.lit(f"{c}="), F.col(c).cast("string"))
    strata = F.array_compact(F.array(
        F.lit("all"), label("same_field"), label("citer_acl"), label("influential"),
        F.when(F.col("horizon_bucket").isin(*HORIZONS), F.concat(F.lit("horizon="), F.col("horizon_bucket"))),
        F.when(F.col("common"), F.concat(F.lit("intent="), F.col("intent"))),
    ))
    expanded = pairs.join(common, "intent", "left").select(F.explode(strata).alias("stratum"), sim)
    return summary(expanded, sim, ["stratum"])


# ---- spread of target sets

def indexed_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense index over pairs with the pairs of a seed next to each other, and the seeds' ranges.

    Both levels use the sliced order statistics, so a seed of any size is indexed in parallel.
    """
    ranges = cumulative(value_counts(pairs, "seed_id"), "seed_id").select(
        "seed_id", F.col("before").alias("start"), F.col("c").alias("size"), F.col("n_rows").alias("n_pairs")
    )
    inside = cumulative(value_counts(pairs, "citer_id", ["seed_id"]), "citer_id", ["seed_id"])
    index = inside.join(ranges, "seed_id").select("seed_id", "citer_id", (F.col("start") + F.col("before")).alias("idx"))
    return index, ranges


def permuted(slot: np.ndarray, room: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Position of each slot under a keyed permutation of 0..room-1.

    A four-round Feistel network permutes the smallest even number of bits that holds the
    room; values outside are sent through again until they fall inside, which keeps it a
    permutation.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(room, 2))).astype(np.int64) + 1) // 2)
    mask = (np.uint64(1) << half.astype(np.uint64)) - np.uint64(1)
    bits, out = half.astype(np.uint64), slot.astype(np.uint64)
    todo = np.arange(len(slot))
    while len(todo):
        left, right = out[todo] >> bits[todo], out[todo] & mask[todo]
        for turn in range(4):
            mixed = (right + key[todo].view(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask[todo])
        out[todo] = (left << bits[todo]) | right
        todo = todo[out[todo] >= room[todo].astype(np.uint64)]
    return out.astype(np.int64)


def random_sets(ranges: DataFrame, repeats: int = 3, seed: int = 0) -> DataFrame:
    """Per seed and repeat as many distinct pair indices of other seeds as the seed has citers.

    A keyed permutation of the other seeds' positions per (seed, repeat) is read at the slots
    0..size-1, one row each, so draws are distinct without meeting and a seed of any size
    spreads over rows.
    """
    others = F.col("n_pairs") - F.col("size")
    jobs = ranges.withColumn("room", others).where("room > 0 and size > 0").select(
        "seed_id", "start", "size", "room", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    slots = jobs.withColumn("key", F.xxhash64("seed_id", "repeat", F.lit(seed))).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.least("size", "room") - 1)).alias("slot"))
    kind = dict(ranges.dtypes)["seed_id"]

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = permuted(*(frame[c].to_numpy(np.int64) for c in ("slot", "room", "key")))
            idx = np.where(at >= frame["start"], at + frame["size"], at)
            yield pd.DataFrame({"seed_id": frame["seed_id"], "repeat": frame["repeat"], "idx": idx})

    return slots.select("seed_id", "repeat", "start", "size", "room", "key", "slot").mapInPandas(
        draw, f"seed_id {kind}, repeat int, idx long")


def spread(items: DataFrame, group: list[str]) -> DataFrame:
    """M09-M11 side by side."""
    return (
        V.vendi(items, group).join(V.mean_pairwise_similarity(items, group).drop("n"), group)
        .join(V.centroid_dispersion(items, group).drop("n"), group)
    )


def target_spread(pairs: DataFrame, vectors: DataFrame, repeats: int = 3, seed: int = 0) -> DataFrame:
    """Spread of each seed's targets next to size-matched random sets of other seeds' targets.

    ``pairs`` has (seed_id, citer_id), ``vectors`` (item_id, vec).
    """
    index, ranges = indexed_pairs(pairs)
    named = vectors.select(F.col("item_id").alias("citer_id"), "vec")
    own = pairs.join(named, "citer_id").select("seed_id", F.col("citer_id").alias("item_id"), "vec")
    drawn = random_sets(ranges, repeats, seed).join(index.select("idx", "citer_id"), "idx").join(named, "citer_id")
    drawn = drawn.select("seed_id", "repeat", F.col("idx").alias("item_id"), "vec")
    random = spread(drawn, ["seed_id", "repeat"]).groupBy("seed_id").agg(
        *[F.avg(c).alias(f"{c}_random") for c in ("vendi", "mps", "disp")]
    )
    return spread(own, ["seed_id"]).join(random, "seed_id")
