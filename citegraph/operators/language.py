"""A language rule learned from texts with known languages: character trigram profiles.

A profile is the ``TOP`` most frequent trigrams of a language, words set apart by single spaces. A text goes to the language
under which its trigrams, as far as any profile holds them, are likeliest (add-one smoothing). Tasks count trigrams as numbers, before
anything is shuffled: learning sends the distinct trigrams of a task, judging one score per text and language. The profiles have at
most ``TOP`` rows per language and go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 400
# Fixed value: what separates words.
BETWEEN_WORDS = r"[^\p{L}]+"
# Characters whose trigrams are held at a time, and distinct trigrams a task holds before it sends them.
CHARS_AT_ONCE = 1_000_000
HELD = 1_000_000


def letters(text: Column) -> Column:
    """The lower-cased words of a text, a space before and after each."""
    words = F.trim(F.regexp_replace(F.lower(text), BETWEEN_WORDS, " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def code_of(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def grams_of(codes: np.ndarray) -> list[str]:
    points = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], axis=1).astype("<u4")
    joined = points.tobytes().decode("utf-32-le", "surrogatepass")
    return [joined[i:i + 3] for i in range(0, len(joined), 3)]


def trigrams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, owner, code) of stretches of texts: all trigrams with the place of their text, repeats included."""
    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (end == start or chars < CHARS_AT_ONCE):
            chars += len(texts[end] or "")
            end += 1
        part = [t or "" for t in texts[start:end]]
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(part)), [len(t) for t in part])
        inside = owner[:-2] == owner[2:]
        codes = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[inside]
        yield start, end, owner[:-2][inside], codes
        start = end


def count_trigrams(known: DataFrame) -> DataFrame:
    """Rows (lang, gram, n) of the texts in rows (lang, text), one or a few per task and trigram."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def sent() -> pa.RecordBatch:
            out = [([lang] * len(codes), grams_of(codes), n) for lang, (codes, n) in held.items()]
            lang, gram = ([x for o in out for x in o[i]] for i in range(2))
            n = np.concatenate([o[2] for o in out]) if out else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end, owner, codes in trigrams(texts):
                which, names = pd.factorize(np.array(langs[start:end], dtype=object))
                for i, lang in enumerate(names):
                    found, n = np.unique(codes[which[owner] == i], return_counts=True)
                    if not len(found):
                        continue
                    if lang in held:
                        more = np.concatenate([held[lang][0], found])
                        found, at = np.unique(more, return_inverse=True)
                        n = np.bincount(at, weights=np.concatenate([held[lang][1], n])).astype(np.int64)
                    held[lang] = found, n
                if sum(len(codes) for codes, _ in held.values()) > HELD:
                    yield sent()
                    held.clear()
        yield sent()

    return known.mapInArrow(local, "lang string, gram string, n long")


def learn_profiles(known: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """Rows (gram, lang, n, logp) for every language and every trigram of any profile."""
    counted = count_trigrams(known.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), letters(F.col(text)).alias("text"))).groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))
    # One row per distinct trigram of a language is ranked, not one per occurrence.
    place = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    grams = counted.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top).select("gram").distinct()
    held = counted.join(F.broadcast(grams), "gram", "left_semi")
    cells = counted.select("lang").distinct().crossJoin(F.broadcast(grams)).join(held, ["lang", "gram"], "left")
    of_lang = Window.partitionBy("lang")
    n = F.coalesce("n", F.lit(0))
    return cells.select("gram", "lang", n.alias("n"), F.log((n + 1) / (F.sum(n).over(of_lang) + F.count(F.lit(1)).over(of_lang))).alias("logp"))


def judge(texts: DataFrame, profiles: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows (key, detected); a text without any trigram of a profile has none, and ties go to the first language by name."""
    rows = profiles.select("gram", "lang", "logp").collect()
    langs, codes = sorted({r["lang"] for r in rows}), np.array(sorted({code_of(r["gram"]) for r in rows}), np.int64)
    logp = np.zeros((len(langs), len(codes)))
    for r in rows:
        logp[langs.index(r["lang"]), np.searchsorted(codes, code_of(r["gram"]))] = r["logp"]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end, owner, grams in trigrams(texts if len(codes) else []):
                at = np.minimum(np.searchsorted(codes, grams), len(codes) - 1)
                known = codes[at] == grams
                owner, at = owner[known], at[known]
                judged = np.unique(owner)
                sums = [np.bincount(owner, weights=own[at], minlength=end - start)[judged] for own in logp]
                key_of = batch.column(0).take(pa.array(start + judged))
                for lang, own in zip(langs, sums):
                    yield pa.RecordBatch.from_arrays([key_of, pa.array([lang] * len(judged), pa.string()), pa.array(own, pa.float64())], [key, "lang", "score"])

    kind = texts.select(key).schema[key].dataType.simpleString()
    votes = texts.select(key, letters(F.col(text)).alias("_letters")).mapInArrow(scores, f"`{key}` {kind}, lang string, score double").groupBy(
        key, "lang").agg(F.sum("score").alias("score"))
    best = votes.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("cost"), "lang")).alias("best"))
    return best.select(key, F.col("best.lang").alias("detected"))
