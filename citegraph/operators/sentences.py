"""C11: sentence boundaries by statistics of the corpus itself.

Abbreviations, sentence starters and collocations are found without labels by log-likelihood
ratios over word counts (the published unsupervised method of Kiss and Strunk, 2006). All counts
are Spark aggregates over all texts; the model is three tables that grow with the vocabulary, so
they are joined and never broadcast by force.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published method: likelihood of a full stop behind an abbreviation and the thresholds.
STOP_AFTER_ABBREVIATION = 0.99
ABBREVIATION_FROM = 0.3
COLLOCATION_FROM = 7.88
STARTER_FROM = 30.0

SPACE = r"[ \t\n\x0B\f\r]+"
# Single characters, cut off by trimming: a trim costs a fraction of a regular expression on every word.
BLANKS, OPENERS, CLOSERS, COMMAS = " \t\n\x0B\f\r", "\"'([", "\"')]", "\"')],;:!?"


def words_of(text: Column) -> Column:
    """The words between white space; null for a null text."""
    return F.array_remove(F.split(F.trim(text, F.lit(BLANKS)), SPACE), "")


def core(word: Column) -> Column:
    """Lower-cased word without quotes, brackets, commas and its last full stop; a number is ``#``."""
    bare = F.rtrim(F.ltrim(word, F.lit(OPENERS)), F.lit(COMMAS))
    plain = F.lower(F.regexp_replace(bare, r"\.\z", ""))
    return F.when(plain.rlike(r"^[0-9.,-]*[0-9]\z"), "#").otherwise(plain)


def dotted(word: Column) -> Column:
    return F.rtrim(word, F.lit(COMMAS)).endswith(".")


def mark(word: Column) -> Column:
    """The last character behind closing quotes and brackets."""
    return F.right(F.rtrim(word, F.lit(CLOSERS)), F.lit(1))


def opens(word: Column) -> Column:
    """Whether a sentence can begin with the word: an upper-case letter or a digit."""
    return F.ltrim(word, F.lit(OPENERS)).rlike(r"^[\p{Lu}0-9]")


def _may_end(word: Column) -> Column:
    """Whether the word holds a mark that ends sentences; false for nearly all words and cheaper than ``mark``."""
    return F.contains(word, F.lit(".")) | F.contains(word, F.lit("!")) | F.contains(word, F.lit("?"))


def _occurrences(texts: DataFrame, text: str) -> DataFrame:
    """(word, next, follows) of every word of every text; only a word with a mark brings its next one, ``follows`` tells words behind one without."""
    words = texts.select(words_of(F.col(text)).alias("w"))
    seen = F.transform("w", lambda w, i: F.struct(
        w.alias("word"), F.when(_may_end(w), F.get("w", i + 1)).alias("next"),
        F.coalesce(~_may_end(F.get("w", i - 1)), F.lit(False)).alias("follows")))
    return words.select(F.explode(seen).alias("p")).select("p.word", "p.next", "p.follows")


def word_pairs(texts: DataFrame, text: str = "text") -> DataFrame:
    """(first, stop, mark, second, opens, n): counts of words and, behind a word with a mark, of neighbouring words, by their cores.

    One pass over the texts. Nothing asks which plain word a word stands behind: such a word is counted once as ``first``
    without a ``second`` and once as ``second`` without a ``first``, so rows grow with the vocabulary and not with all pairs of
    neighbours. All tables of the model are sums over this one.
    """
    seen = _occurrences(texts, text).groupBy("word", "next", "follows").agg(F.count(F.lit(1)).alias("n"))
    last = mark(F.col("word"))
    known = seen.select(
        core(F.col("word")).alias("first"), dotted(F.col("word")).alias("stop"),
        F.when(last.isin("!", "?"), last).when(last == ".", last).alias("mark"),
        core(F.col("next")).alias("second"), F.coalesce(opens(F.col("next")), F.lit(False)).alias("opens"), "follows", "n",
    )
    row = F.struct("first", "stop", "mark", "second", "opens")
    behind = F.struct(
        F.lit(None).cast("string").alias("first"), F.lit(False).alias("stop"), F.lit(None).cast("string").alias("mark"),
        F.col("first").alias("second"), F.lit(False).alias("opens"))
    both = known.select(F.explode(F.when(F.col("follows"), F.array(row, behind)).otherwise(F.array(row))).alias("p"), "n")
    return both.groupBy("p.first", "p.stop", "p.mark", "p.second", "p.opens").agg(F.sum("n").alias("n"))


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k hits among n at rate p, with 0 log 0 = 0."""
    return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(0.0)


def collocation_ratio(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Log-likelihood ratio of ``second`` depending on ``first``; 0 where the first does not favour it."""
    whole, inside, outside = second / total, both / first, F.when(total > first, (second - both) / (total - first)).otherwise(0.0)
    ratio = -2 * (_likelihood(both, first, whole) + _likelihood(second - both, total - first, whole)
                  - _likelihood(both, first, inside) - _likelihood(second - both, total - first, outside))
    return F.when(inside > whole, ratio).otherwise(0.0)


def abbreviations(pairs: DataFrame) -> DataFrame:
    """(word, n_stop, n_plain, score) of the words seen before a full stop; ``score`` tells abbreviations.

    The ratio compares "nearly always before a full stop" with chance. It is weighed down by the
    length and by every occurrence without a full stop, and up by inner full stops.
    """
    counts = pairs.where(F.col("first") != "").groupBy(F.col("first").alias("word")).agg(
        F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("n_stop"),
        F.sum(F.when(F.col("stop"), 0).otherwise(F.col("n"))).alias("n_plain"),
    )
    # One row, joined as a constant.
    totals = counts.agg(F.sum("n_stop").alias("stops"), F.sum(F.col("n_stop") + F.col("n_plain")).alias("total"))
    k, n = F.col("n_stop"), F.col("n_stop") + F.col("n_plain")
    chance, always = _likelihood(k, n, F.col("stops") / F.col("total")), _likelihood(k, n, F.lit(STOP_AFTER_ABBREVIATION))
    dots = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = (F.length("word") - dots).cast("double")
    score = -2 * (chance - always) * F.exp(-letters) * (dots + 1) * F.pow(letters, -F.col("n_plain"))
    worded = F.col("word").rlike(r"\p{L}")
    return counts.where(k > 0).crossJoin(F.broadcast(totals)).select(
        "word", "n_stop", "n_plain", F.when(worded, score).otherwise(0.0).alias("score"))


def _shortened(pairs: DataFrame, abbrevs: DataFrame) -> DataFrame:
    """The pairs whose first word has a mark, with ``short``: it is an abbreviation or an initial with its full stop."""
    known = abbrevs.where(F.col("score") >= ABBREVIATION_FROM).select(F.col("word").alias("first"), F.lit(True).alias("known"))
    initial = F.col("first").rlike(r"^\p{L}$")
    marked = pairs.where(F.col("stop") | F.col("mark").isNotNull())
    return marked.join(known, "first", "left").withColumn(
        "short", F.col("stop") & (F.coalesce("known", F.lit(False)) | initial)).drop("known")


def _inner(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("second").isNotNull() & (F.col("second") != ""))


def starters(pairs: DataFrame, abbrevs: DataFrame) -> DataFrame:
    """(word, n_after, n_all, ratio) of words behind a sure sentence end; a high ``ratio`` tells sentence starters.

    A sure end is a question or exclamation mark, or the full stop of a word that is no
    abbreviation, initial or number.
    """
    ends = F.col("mark").isNotNull() & F.col("opens") & ~F.col("short") & ((F.col("first") != "#") | (F.col("mark") != "."))
    none = F.lit(0).cast("long")
    after = _inner(_shortened(pairs, abbrevs)).where(ends).select(F.col("second").alias("word"), F.col("n").alias("n_after"), none.alias("n_all"))
    every = _inner(pairs).select(F.col("second").alias("word"), none.alias("n_after"), F.col("n").alias("n_all"))
    counts = after.unionByName(every).groupBy("word").agg(F.sum("n_after").alias("n_after"), F.sum("n_all").alias("n_all"))
    totals = counts.agg(F.sum("n_after").alias("ends"), F.sum("n_all").alias("total"))
    ratio = collocation_ratio(F.col("n_after"), F.col("ends"), F.col("n_all"), F.col("total"))
    return counts.where(F.col("n_after") > 0).crossJoin(F.broadcast(totals)).select("word", "n_after", "n_all", ratio.alias("ratio"))


def collocations(pairs: DataFrame, abbrevs: DataFrame) -> DataFrame:
    """(first, second, n, ratio): an abbreviation, initial or number with its full stop and a word bound to it, seen twice or more."""
    inner = _inner(pairs)
    bound = _inner(_shortened(pairs, abbrevs)).where(F.col("stop") & (F.col("short") | (F.col("first") == "#")))
    both = bound.groupBy("first", "second").agg(F.sum("n").alias("n")).where(F.col("n") >= 2)
    lefts = bound.groupBy("first").agg(F.sum("n").alias("n_first"))
    rights = inner.groupBy("second").agg(F.sum("n").alias("n_second"))
    totals = inner.agg(F.sum("n").alias("total"))
    ratio = collocation_ratio(F.col("n"), F.col("n_first"), F.col("n_second"), F.col("total"))
    return both.join(lefts, "first").join(rights, "second").crossJoin(F.broadcast(totals)).select("first", "second", "n", ratio.alias("ratio"))


def joined_pairs(pairs: DataFrame) -> DataFrame:
    """(first, second): words between which a full stop ends no sentence, although the second could begin one.

    An abbreviation or initial ends a sentence only before a sentence starter; neither it nor a
    number ends one inside a collocation.
    """
    abbrevs = abbreviations(pairs)
    starting = starters(pairs, abbrevs).where(F.col("ratio") >= STARTER_FROM).select(F.col("word").alias("second"), F.lit(True).alias("starts"))
    tied = collocations(pairs, abbrevs).where(F.col("ratio") >= COLLOCATION_FROM).select("first", "second", F.lit(True).alias("tied"))
    met = _shortened(pairs, abbrevs).where((F.col("mark") == ".") & F.col("opens") & (F.col("short") | (F.col("first") == "#")))
    asked = met.groupBy("first", "second").agg(F.max("short").alias("short"))
    asked = asked.join(starting, "second", "left").join(tied, ["first", "second"], "left")
    return asked.where(F.col("tied").isNotNull() | (F.col("short") & F.col("starts").isNull())).select("first", "second")


def split(texts: DataFrame, key: Sequence[str], kept: DataFrame, text: str = "text") -> DataFrame:
    """The texts with ``sentences``; ``key`` is unique and ``kept`` comes from ``joined_pairs``.

    A sentence ends behind ``.``, ``!`` or ``?`` before a word that can begin one, unless a full
    stop stands inside a pair of ``kept``. White space inside a sentence becomes one space; a null or
    blank text has no sentences. Only the places in question meet the table, not the texts.
    """
    key = list(key)
    cut = words_of(F.coalesce(text, F.lit("")))
    words = texts.select(*key, cut.alias("_words"))
    following = lambda i: F.get("_words", i + 1)
    places = F.array_compact(F.transform("_words", lambda w, i: F.when(
        _may_end(w) & mark(w).isin(".", "!", "?") & following(i).isNotNull() & opens(following(i)),
        F.struct((i + 1).alias("at"), w.alias("word"), following(i).alias("next")))))
    asked = words.select(*key, F.explode(places).alias("p")).select(
        *key, "p.at", core(F.col("p.word")).alias("first"), core(F.col("p.next")).alias("second"), (mark(F.col("p.word")) == ".").alias("_stop"))
    held = kept.select("first", "second", F.lit(True).alias("_stop"))
    cuts = asked.join(held, ["first", "second", "_stop"], "left_anti").groupBy(*key).agg(F.array_sort(F.collect_list("at")).alias("_cuts"))
    # The texts travel as they are and become words again behind the join.
    found = texts.join(cuts, key, "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<int>"))).withColumn("_words", cut)
    edges = F.concat(F.array(F.lit(0)), "_cuts", F.array(F.size("_words")))
    pieces = F.transform(
        F.arrays_zip(F.slice(edges, 1, F.size("_cuts") + 1).alias("a"), F.slice(edges, 2, F.size("_cuts") + 1).alias("b")),
        lambda e: F.array_join(F.slice("_words", e["a"] + 1, e["b"] - e["a"]), " "),
    )
    return found.withColumn("sentences", F.filter(pieces, lambda s: s != "")).drop("_words", "_cuts")


def learned_sentences(
    texts: DataFrame, key: Sequence[str], text: str = "text", keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """The texts with sentences cut by the statistics of these very texts.

    The counts are read several times: ``keep`` may write them once (``session.materialise``).
    """
    return split(texts, key, joined_pairs(keep(word_pairs(texts, text))), text)
