"""Lexical diversity and overlap of text sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType

from ..functions import lexical as L
from ..functions.stemming import porter
from ..functions.text import strip, tokens, word_count

BLOCK_TEXTS = 64
# Characters of the largest set whose n-grams are counted in one place.
WHOLE_SET = 1_000_000

# The published 13a tokenisation rules, applied in this order (Java syntax).
ENTITIES_13A = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
RULES_13A = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "),
)


def distinct_n(texts: DataFrame, group: Sequence[str], n: int = 2, text: str = "text") -> DataFrame:
    """Unique n-grams over all n-grams of a group; NaN when it has none.

    N-grams are counted per (group, n-gram) first, so a large group is spread over its
    n-grams and combined map-side.
    """
    words = texts.select(*group, tokens(F.col(text)).alias("words"))
    starts = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - (n - 1)))
    grams = words.select(*group, F.explode_outer(F.transform(starts, lambda i: F.slice("words", i, n))).alias("gram"))
    counted = grams.groupBy(*group, "gram").agg(F.count("gram").alias("c"))
    total, unique = F.sum("c"), F.count("gram")
    return counted.groupBy(*group).agg(
        F.when(total > 0, unique / total).otherwise(F.lit(float("nan"))).alias(f"distinct{n}")
    )


def mean_length(texts: DataFrame, group: Sequence[str], text: str = "text") -> DataFrame:
    """Mean number of words."""
    return texts.groupBy(*group).agg(F.avg(word_count(F.col(text))).alias("mean_len"))


def _words_13a(text: Column) -> Column:
    """Tokens by the published 13a rules."""
    for old, new in ENTITIES_13A:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, replacement in RULES_13A:
        text = F.regexp_replace(text, pattern, replacement)
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def _matched_grams(words: DataFrame, group: list[str]) -> DataFrame:
    """(group, id, h1..h4): a text's n-grams also found in one of the others, each as often as in one of them at most.

    Per n-gram the largest count with a holder and the largest count of all other texts are
    enough: the holder is clipped by the second, everyone else by the first.
    """
    starts = lambda n: F.when(F.size("words") >= n, F.transform(
        F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.slice("words", i, n))).otherwise(F.array().cast("array<array<string>>"))
    grams = words.select(*group, "id", F.explode(F.concat(*[starts(n) for n in range(1, 5)])).alias("gram"))
    counts = grams.where("id is not null").groupBy(*group, "gram", "id").agg(F.count(F.lit(1)).alias("c"))
    first = counts.groupBy(*group, "gram").agg(F.max(F.struct("c", "id")).alias("top"))
    held = counts.join(first, [*group, "gram"])
    others = held.where(F.col("id") != F.col("top.id")).groupBy(*group, "gram").agg(F.max("c").alias("second"))
    met = held.join(others, [*group, "gram"])
    allowed = F.when(F.col("id") == F.col("top.id"), F.col("second")).otherwise(F.col("top.c"))
    return met.groupBy(*group, "id").agg(*[
        F.sum(F.when(F.size("gram") == n, F.least("c", allowed)).otherwise(0)).alias(f"h{n}") for n in range(1, 5)])


def _spread_rows(words: DataFrame, group: list[str]) -> DataFrame:
    """(group, len, closest, h1..h4) of every text, n-gram by n-gram, for sets too large for one place."""
    words = words.withColumn("len", F.size("words"))
    # Sets have far fewer lengths than texts.
    lengths = words.groupBy(*group, "len").agg(F.count(F.lit(1)).alias("same"))
    near = Window.partitionBy(*group).orderBy("len")
    lengths = lengths.withColumn("shorter", F.lag("len").over(near)).withColumn("longer", F.lead("len").over(near))
    closest = F.when(F.col("same") > 1, F.col("len")).when(F.col("shorter").isNull(), F.col("longer")).when(
        F.col("longer").isNull() | (F.col("len") - F.col("shorter") <= F.col("longer") - F.col("len")), F.col("shorter")).otherwise(F.col("longer"))
    lengths = lengths.select(*group, "len", closest.alias("closest"))
    hits = _matched_grams(words, group)
    return words.select(*group, "id", "len").join(lengths, [*group, "len"]).join(hits, [*group, "id"], "left").drop("id")


def self_bleu(texts: DataFrame, group: Sequence[str], order: str, text: str = "text", whole: int = WHOLE_SET) -> DataFrame:
    """Mean BLEU (0-100, exponential smoothing, effective order) of each text against all others of its set.

    Blank texts are left out; a set of fewer than two texts has NaN. The work is linear in the
    n-grams. The reference length is the closest among the other texts, the shorter of two.
    Texts are shuffled once, by their set; a set of up to ``whole`` characters is counted where its
    texts meet, and only the n-grams of larger ones travel.
    """
    group = list(group)

    @arrow_udf(ArrayType(ArrayType(LongType())))
    def counted(sets: pa.Array) -> pa.Array:
        rows = [L.matched_orders([t["words"] for t in one], [t["id"] for t in one]) for one in sets.to_pylist()]
        return pa.array(rows, pa.list_(pa.list_(pa.int64())))

    met = texts.where(strip(F.col(text)) != "").where(" and ".join(f"`{g}` is not null" for g in group)).select(
        *group, F.col(order).alias("id"), F.col(text).alias("text"))
    met = met.withColumn("_chars", F.sum(F.length("text")).over(Window.partitionBy(*group)))
    words = lambda rows: rows.select(
        *group, "id", _words_13a(F.regexp_replace("text", r"(?U)\s+$", "")).alias("words"))
    sets = words(met.where(F.col("_chars") <= whole)).groupBy(*group).agg(F.collect_list(F.struct("id", "words")).alias("texts"))
    names = ["len", "closest", "h1", "h2", "h3", "h4"]
    near = sets.select(*group, F.explode(counted("texts")).alias("p")).select(*group, *[F.col("p")[i].alias(n) for i, n in enumerate(names)])
    rows = near.unionByName(_spread_rows(words(met.where(F.col("_chars") > whole)), group).select(*group, *names))
    zeros, logs, orders, matched = F.lit(0), F.lit(0.0), F.lit(0), F.lit(0)
    for n in range(1, 5):
        total = F.col("len") - (n - 1)
        hits = F.coalesce(F.col(f"h{n}"), F.lit(0))
        used = total > 0
        zeros = zeros + (used & (hits == 0)).cast("int")
        share = F.when(hits > 0, F.log(100.0 * hits / total)).otherwise(F.log(100.0 / (F.pow(F.lit(2.0), zeros) * total)))
        logs, orders, matched = logs + F.when(used, share).otherwise(0.0), orders + used.cast("int"), matched + hits
    brevity = F.when(F.col("len") >= F.col("closest"), 1.0).otherwise(F.exp(1 - F.col("closest") / F.col("len")))
    bleu = F.when(matched > 0, brevity * F.exp(logs / orders)).otherwise(0.0)
    scored = rows.groupBy(*group).agg(F.avg(bleu).alias("mean"), F.count(F.lit(1)).alias("n"))
    return scored.select(*group, F.when(F.col("n") >= 2, F.col("mean")).otherwise(F.lit(float("nan"))).alias("self_bleu"))


def _piece_counts(texts: DataFrame, group: list[str], name: str) -> DataFrame:
    """(group, name): number of blocks of about BLOCK_TEXTS texts."""
    return texts.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS).cast("int").alias(name))


def _dealt(texts: DataFrame, sizes: DataFrame, group: list[str], spread: Column, name: str) -> DataFrame:
    """The texts with the number of their block, dealt evenly by a hash."""
    return texts.join(sizes, group).withColumn("_piece", F.pmod(F.xxhash64(spread), F.col(name)).cast("int")).drop(name)


def rouge_l_max(
    predictions: DataFrame, references: DataFrame, group: Sequence[str], order: str, text: str = "text",
    stem: Callable[[str], str] | None = porter,
) -> DataFrame:
    """Mean over references of the best ROUGE-L F1 against all predictions of the group.

    Equal references of a group are scored once and weighted; a null reference counts as empty,
    blank predictions do not count and a group without predictions has no row. Every text becomes tokens
    once. A block of references meets a block of predictions in one row under a key of its own, so
    a hot group spreads over the tasks; inside it an inverted index bounds every score and most
    pairs are never scored (``PredictionIndex``). The best of the blocks counts.
    """
    group = list(group)

    @arrow_udf(ArrayType(StringType()))
    def words(texts: pa.Array) -> pa.Array:
        return pa.array([L.rouge_tokens(t, stem) for t in texts.to_pylist()], pa.list_(pa.string()))

    @arrow_udf(ArrayType(DoubleType()))
    def best(refs: pa.Array, items: pa.Array) -> pa.Array:
        scores = []
        for targets, texts in zip(refs, items):
            index = L.PredictionIndex(texts.as_py())
            scores.append([index.best(target) for target in targets.as_py()])
        return pa.array(scores, pa.list_(pa.float64()))

    targets = references.groupBy(*group, F.coalesce(text, F.lit("")).alias("reference")).agg(F.count(F.lit(1)).alias("times"))
    texts = predictions.where(strip(F.col(text)) != "").select(*group, F.col(order).alias("_order"), F.col(text).alias("item"))
    pieces = _piece_counts(targets, group, "_pieces")
    target_blocks = _dealt(targets, pieces, group, F.col("reference"), "_pieces").select(
        *group, "_piece", "times", words("reference").alias("words"),
    ).groupBy(*group, "_piece").agg(F.array_sort(F.collect_list(F.struct("words", "times"))).alias("targets"))
    text_blocks = _dealt(texts, _piece_counts(texts, group, "_blocks"), group, F.col("_order"), "_blocks").select(
        *group, F.col("_piece").alias("_block"), words("item").alias("words"),
    ).groupBy(*group, "_block").agg(F.collect_list("words").alias("texts"))
    copies = text_blocks.join(pieces, group).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    met = target_blocks.join(copies, [*group, "_piece"])
    scored = met.select(*group, "_piece", F.col("targets.times").alias("times"), best("targets.words", "texts").alias("best"))
    # A piece's targets are sorted, so a place means the same target in every row of the piece.
    by_target = scored.select(*group, "_piece", F.posexplode(F.arrays_zip("times", "best")).alias("at", "s"))
    tops = by_target.groupBy(*group, "_piece", "at").agg(F.max("s.best").alias("best"), F.max("s.times").alias("times"))
    return tops.groupBy(*group).agg((F.sum(F.col("best") * F.col("times")) / F.sum("times")).alias("rouge_l"))
