"""Model operators: back ends plug in as small objects, Spark moves the data.

A back end is created once per task by a zero-argument factory, sees Arrow batches of
rows and never the whole table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from ..functions.hashing import text_key
from ..functions.text import citer_prompt, extract, instructions, label_prompt, parse_labels, split_sentences, strip_reasoning
from ..params import CONDITIONS, MAX_SENTENCES, N_GENERATIONS, sampling_for


class Encoder(Protocol):
    def encode(self, texts: Sequence[str]) -> np.ndarray:
        """Unit-norm float32 rows, one per text."""


class Reranker(Protocol):
    def score(self, queries: Sequence[str], documents: Sequence[str]) -> Sequence[float]:
        """Match probability per (query, document)."""


class Generator(Protocol):
    def sample(self, prompts: Sequence[str], n_calls: Sequence[int], settings: dict) -> list[list[str]]:
        """Raw replies, ``n_calls[i]`` of them for prompt i; ``settings["system"]`` says what to write."""


class Labeller(Protocol):
    def reply(self, prompts: Sequence[str]) -> Sequence[str]:
        """One raw reply per prompt."""


# ---- language

def language_rule(detect: Callable[[str], str], language: str = "en") -> Callable[[DataFrame], Column]:
    """Rule for ``english_pairs`` from a detector; a detector error means "no"."""
    @pandas_udf(BooleanType())
    def verdict(texts: pd.Series) -> pd.Series:
        def check(text):
            try:
                return detect(text) == language
            except Exception:
                return False
        return texts.map(check)

    return lambda citers: verdict(citers["abstract"])


# Common English words of the word-share rule.
ENGLISH_WORDS = frozenset("a an and are as at by for from in is it of on or that the this to we with".split())


def word_share_language(text: str) -> str:
    """'en' when common English words make up an eighth of the words, else 'other'."""
    words = re.findall(r"\w+", text.lower())
    return "en" if words and sum(w in ENGLISH_WORDS for w in words) * 8 >= len(words) else "other"


def langdetect_language(text: str) -> str:
    """The ``langdetect`` package with a fixed seed; workers without it fail instead of deciding otherwise."""
    from langdetect import DetectorFactory, detect

    DetectorFactory.seed = 0
    return detect(text)


# Which citers a cut keeps depends on the detector, so a caller names one.
DETECTORS: dict[str, Callable[[str], str]] = {"langdetect": langdetect_language, "word-share": word_share_language}


# ---- embedding

def embed(texts: DataFrame, factory: Callable[[], Encoder], key: str = "text_key", text: str = "text") -> DataFrame:
    """(key, vec) of each row."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for frame in frames:
            if len(frame):
                vectors = np.asarray(encoder.encode(frame["text"].tolist()), dtype=np.float32)
                yield pd.DataFrame({"text_key": frame["text_key"], "vec": list(vectors)})

    return texts.select(F.col(key).alias("text_key"), F.col(text).alias("text")).mapInPandas(
        run, "text_key string, vec array<float>"
    )


def cache_misses(texts: DataFrame, cache: DataFrame | None, text: str = "text", algorithm: str = "blake2b") -> DataFrame:
    """Distinct (text_key, text) not in the cache yet."""
    wanted = texts.select(text_key(F.col(text), algorithm).alias("text_key"), F.col(text).alias("text"))
    wanted = wanted.dropDuplicates(["text_key"])
    return wanted if cache is None else wanted.join(cache.select("text_key"), "text_key", "left_anti")


def embed_cached(
    texts: DataFrame, factory: Callable[[], Encoder], path: str, encoder: str, text: str = "text",
    algorithm: str = "blake2b",
) -> DataFrame:
    """``texts`` with ``vec``; only texts missing from the cache at ``path`` are encoded.

    The cache is a Parquet table partitioned by encoder; misses are appended to it, then
    all vectors are read back.
    """
    spark = texts.sparkSession
    cache = _read_cache(spark, path, encoder)
    fresh = embed(cache_misses(texts, cache, text, algorithm), factory)
    fresh.withColumn("encoder", F.lit(encoder)).write.mode("append").partitionBy("encoder").parquet(path)
    known = _read_cache(spark, path, encoder).select("text_key", "vec").dropDuplicates(["text_key"])
    return (
        texts.withColumn("text_key", text_key(F.col(text), algorithm)).join(known, "text_key", "left").drop("text_key")
    )


def _read_cache(spark, path: str, encoder: str) -> DataFrame | None:
    from ..sources.layers import exists
    if not exists(spark, path):
        return None
    stored = spark.read.schema("text_key string, vec array<float>, encoder string").parquet(path)
    return stored.where(F.col("encoder") == encoder)


# ---- reranking

def rerank(targets: DataFrame, generations: DataFrame, factory: Callable[[], Reranker]) -> DataFrame:
    """(seed_id, citer_id, n_gen, probs) of each target against all its seed's generations.

    ``targets`` has (seed_id, citer_id, text); ``generations`` one row per seed with the
    array ``predictions``. Texts are passed whole; a back end with a window of its own scores
    the windows. Targets stay rows, so a seed with many targets spreads over tasks. Seeds
    without generations have no output.
    """
    documents = generations.select("seed_id", F.col("predictions").alias("documents")).where(F.size("documents") > 0)
    joined = targets.select("seed_id", "citer_id", F.col("text").alias("query")).join(documents, "seed_id")
    kinds = dict(joined.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reranker = factory()
        for frame in frames:
            sizes = [len(d) for d in frame["documents"]]
            queries = [q for q, n in zip(frame["query"], sizes) for _ in range(n)]
            scores = np.asarray(reranker.score(queries, [d for ds in frame["documents"] for d in ds]), dtype=np.float32)
            # Probabilities are kept with the precision of a half float.
            scores = scores.astype(np.float16).astype(np.float32)
            cuts = np.split(scores, np.cumsum(sizes)[:-1]) if sizes else []
            yield pd.DataFrame(
                {"seed_id": frame["seed_id"], "citer_id": frame["citer_id"], "n_gen": sizes, "probs": cuts}
            )

    return joined.mapInPandas(
        run, f"seed_id {kinds['seed_id']}, citer_id {kinds['citer_id']}, n_gen int, probs array<float>"
    )


# ---- generation

def ask(prompts: DataFrame, factory: Callable[[], Generator], condition: str) -> DataFrame:
    """(seed_id, raw): ``n_calls`` raw replies to each row's ``prompt``.

    The condition's instructions travel with its settings, since they are the same for all seeds.
    """
    settings = sampling_for(CONDITIONS[condition]) | {"system": instructions(CONDITIONS[condition])}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = factory()
        for frame in frames:
            raws = generator.sample(frame["prompt"].tolist(), frame["n_calls"].tolist(), settings)
            yield pd.DataFrame({"seed_id": frame["seed_id"], "raw": raws})

    return prompts.select("seed_id", "prompt", "n_calls").mapInPandas(run, "seed_id string, raw array<string>")


def reply_texts(replies: DataFrame, condition: str) -> DataFrame:
    """(seed_id, call, texts): usable texts of every reply, by the one rule that counts and keeps them."""
    order = [c for c in ("round",) if c in replies.columns]
    calls = replies.select("seed_id", *order, F.posexplode_outer("raw").alias("call", "reply"))
    return calls.select(
        "seed_id", F.struct(*order, "call").alias("call"),
        extract(F.coalesce("reply", F.lit("")), CONDITIONS[condition].kind).alias("texts"),
    )


def still_short(seeds: DataFrame, replies: DataFrame | None, condition: str, n: int) -> DataFrame:
    """(seed_id, prompt, n_calls) of seeds with fewer than ``n`` usable texts, and the calls that fill the gap."""
    prompts = seeds.select(
        F.col("seed_id").cast("string").alias("seed_id"),
        citer_prompt(F.col("seed_title"), F.col("seed_year"), F.col("seed_abstract")).alias("prompt"),
    )
    have = F.lit(0)
    if replies is not None:
        counts = reply_texts(replies, condition).groupBy("seed_id").agg(F.sum(F.size("texts")).alias("have"))
        prompts, have = prompts.join(counts, "seed_id", "left"), F.coalesce("have", F.lit(0))
    gap = F.ceil((F.lit(n) - have) / F.lit(CONDITIONS[condition].per_call)).cast("int")
    return prompts.withColumn("n_calls", gap).where(F.col("n_calls") > 0).select("seed_id", "prompt", "n_calls")


def predictions(replies: DataFrame, condition: str, n: int = N_GENERATIONS) -> DataFrame:
    """Generation records from raw replies: all cleaned texts in order, and what is missing of ``n``."""
    plan = CONDITIONS[condition]
    # A seed has at most as many replies as the rounds asked for.
    gathered = reply_texts(replies, condition).groupBy("seed_id").agg(F.array_sort(F.collect_list(F.struct("call", "texts"))).alias("calls"))
    texts = F.flatten(F.transform("calls", lambda c: c["texts"]))
    return gathered.select(
        "seed_id", F.lit(condition).alias("condition"), F.lit(sampling_for(plan)["model"]).alias("model"),
        texts.alias("predictions"), F.greatest(F.lit(n) - F.size(texts), F.lit(0)).alias("short_by"),
    )


# ---- labelling

def label_texts(
    items: DataFrame, factory: Callable[[], Labeller], key: list[str], splitter=split_sentences, per_prompt: int = MAX_SENTENCES,
) -> DataFrame:
    """(key, labels), one label or NULL per sentence of ``text``.

    The sentences are asked about in windows of ``per_prompt``, each numbered from 0, and the
    windows' labels joined again in order. A text without a sentence has no labels. Without a
    ``splitter`` the items bring their ``sentences`` (``operators.sentences``).
    """
    kinds = dict(items.dtypes)
    title = F.col("title") if "title" in items.columns else F.lit(None).cast("string")
    sentences = F.col("sentences") if splitter is None else splitter(F.col("text"))
    split = items.select(*key, title.alias("title"), sentences.alias("sentences"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("sentences"), F.lit(1)), F.lit(per_prompt))
    windows = split.select(*key, "title", "sentences", F.posexplode(starts).alias("window", "start")).select(
        *key, "window", "title", F.slice("sentences", F.col("start"), F.lit(per_prompt)).alias("part"),
    ).select(*key, "window", F.size("part").alias("n"), label_prompt(F.col("title"), F.col("part")).alias("prompt"))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", window int, n int, reply string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = factory()
        for frame in frames:
            asked = frame["n"] > 0
            replies = pd.Series("", index=frame.index, dtype=object)
            if asked.any():
                replies[asked] = list(labeller.reply(frame.loc[asked, "prompt"].tolist()))
            yield frame[[*key, "window", "n"]].assign(reply=replies)

    answered = windows.mapInPandas(run, schema)
    labelled = answered.select(*key, "window", parse_labels(strip_reasoning(F.col("reply")), F.col("n")).alias("labels"))
    return labelled.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("window", "labels"))).alias("parts")).select(
        *key, F.flatten(F.transform("parts", lambda p: p["labels"])).alias("labels"))
