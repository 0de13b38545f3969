"""Removal of result sentences from citer abstracts and from generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import audited, kept_text, split_sentences, word_count
from ..params import MAX_SENTENCES, SENTENCE_LABELS


def strip_units(units: DataFrame, labels: DataFrame | None, key: list[str], splitter=split_sentences) -> DataFrame:
    """Per unit the audit list, the rewritten text and whether it is emptied.

    ``units`` has the key and ``text``; ``labels`` the key and ``labels``. A unit without
    labels is an error, as is a list of the wrong length. Without a ``splitter`` the units bring
    their ``sentences`` (``operators.sentences``), and without a table of ``labels`` their ``labels``.
    """
    split = units if splitter is None else units.withColumn("sentences", splitter(F.col("text")))
    joined = split if labels is None else split.join(labels, key, "left")
    missing = F.raise_error(F.lit("unit without labels")).cast("array<string>")
    audit = audited(F.col("sentences"), F.when(F.col("labels").isNull(), missing).otherwise(F.col("labels")))
    return (
        joined.withColumn("audit", audit).drop("sentences", "labels")
        .withColumn("kept", kept_text(F.col("audit")))
        .withColumn("emptied", ~F.exists("audit", lambda s: ~s["removed"]))
    )


def no_labels(sentences: Column) -> Column:
    """One NULL label per sentence, for texts that are not labelled."""
    return F.transform(sentences, lambda _: F.lit(None).cast("string"))


def labelable(sentences: Column) -> Column:
    """A labeller only sees texts with 1 to ``MAX_SENTENCES`` sentences."""
    return F.size(sentences).between(1, MAX_SENTENCES)


def removal_counters(stripped: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Counters over distinct units; ``text`` holds the original."""
    n, n_removed = F.size("audit"), F.size(F.filter("audit", lambda s: s["removed"]))
    yes = lambda cond: F.sum(cond.cast("long"))
    with_label = lambda name: F.size(F.filter("audit", lambda s: s["label"] == name))
    last = F.coalesce(F.try_element_at(F.col("audit"), F.lit(-1))["removed"], F.lit(False))
    return stripped.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("units"),
        F.sum(n).alias("sentences"),
        F.sum(n_removed).alias("sentences_removed"),
        yes(n > MAX_SENTENCES).alias("unlabelled_too_long"),
        yes(n == n_removed).alias("emptied"),
        yes(n - n_removed == 1).alias("one_sentence_left"),
        yes(n_removed == 0).alias("unchanged"),
        yes(last).alias("last_sentence_removed"),
        F.sum(word_count(F.col("text"))).alias("words"),
        F.sum(word_count(F.col("kept"))).alias("words_kept"),
        *[F.sum(with_label(label)).alias(f"label_{label}") for label in SENTENCE_LABELS],
        F.sum(F.size(F.filter("audit", lambda s: s["label"].isNull()))).alias("label_UNPARSED"),
    )


def refloor(pairs: DataFrame, stripped: DataFrame, min_citers: int) -> tuple[DataFrame, DataFrame]:
    """F16: pairs with a non-empty rewritten citer, of seeds still at the floor, and the seed counts.

    The second table has every seed with its surviving citers and whether it stays.
    """
    survivors = pairs.join(stripped.where(~F.col("emptied")).select("citer_id"), "citer_id", "left_semi")
    counts = survivors.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n_left"))
    before = pairs.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n_before"))
    seeds = before.join(counts, "seed_id", "left").select(
        "seed_id", "n_before", F.coalesce("n_left", F.lit(0)).alias("n_left"),
        (F.coalesce("n_left", F.lit(0)) >= min_citers).alias("stays"),
    )
    kept = survivors.join(counts.where(F.col("n_left") >= min_citers), "seed_id")
    return kept.drop("n_citers").withColumnRenamed("n_left", "n_citers"), seeds


def removal_totals(seeds: DataFrame) -> DataFrame:
    """Pair and seed counters after the floor; pairs of dropped seeds are counted apart."""
    total = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0))
    stays = F.col("stays")
    return seeds.agg(
        total(stays, F.lit(1)).alias("seeds"), total(stays, F.col("n_left")).alias("pairs"),
        F.coalesce(F.sum(F.col("n_before") - F.col("n_left")), F.lit(0)).alias("pairs_dropped_emptied"),
        total(~stays, F.lit(1)).alias("seeds_dropped_under_floor"),
        total(~stays, F.col("n_left")).alias("pairs_dropped_with_seed"),
    )
