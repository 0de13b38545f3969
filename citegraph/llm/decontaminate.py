"""Benchmark decontamination by template canonicalisation.

Texts become tokens; numbers, capitalised words and units after numbers turn into typed placeholders, all other words are
lower-cased. Windows of ``WINDOW`` tokens of the benchmark are hashed in two views: the template (used where at least half of the
window is words) and the lower-cased tokens themselves, which also finds copies whose case changed. Document windows meet them in
a hash join. Per document, item and alignment the values in the slots of its template windows must map one to one, or these windows
do not count; an item counts as contained if its other windows cover at least ``COVERED`` of its tokens.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, materialise, table, text_of, unkeyed, unused, without

WINDOW = 8
SHORTEST = 3
COVERED = 0.5
# Benchmark windows up to which documents are filtered by a broadcast set (8 bytes a window) before the join.
FILTER_WINDOWS = 4_000_000
KEPT = 600_000
# Characters of text whose windows are hashed at a time.
BATCH_CHARS = 2_000_000
# Units that may follow a number.
UNITS = set("""
mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ton tons ml l liter liters litre litres gal
gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp
dollar dollars cent cents euro euros pound pounds yen percent degree degrees mph kmh km/h hz khz mhz ghz w kw v a j kj cal kcal pa
""".split())
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
_tokens = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+").findall


def _hash(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1], 77)


_PLACE = np.array([0, _hash("<number>"), _hash("<name>"), _hash("<unit>")], dtype=np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)


class Words(dict):
    """Token -> row of the arrays (hash of the lower-cased token, kind, may be a unit)."""

    def __init__(self):
        super().__init__()
        self.raw, self.kind, self.unit = np.zeros(1024, np.uint64), np.zeros(1024, np.int8), np.zeros(1024, bool)

    def __missing__(self, token: str) -> int:
        i = len(self)
        if i == len(self.raw):
            self.raw, self.kind, self.unit = (np.concatenate([x, np.zeros_like(x)]) for x in (self.raw, self.kind, self.unit))
        low = token.lower()
        self.raw[i], self.unit[i] = _hash(low), low in UNITS
        self.kind[i] = NUMBER if token[0].isdigit() else NAME if token[0].isupper() else LITERAL
        self[token] = i
        return i


def encode(lists: list[list[str]], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of some texts: hash of the lower-cased token, hash of the template token, kind; and the tokens per text."""
    if len(words) > KEPT:
        words.clear()
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter(map(words.__getitem__, chain.from_iterable(lists)), np.int64, int(lengths.sum()))
    raw, kind = words.raw[ids], words.kind[ids]
    after_number = np.zeros(len(ids), bool)
    after_number[1:] = kind[:-1] == NUMBER
    heads = (np.cumsum(lengths) - lengths)[lengths > 0]
    after_number[heads] = False
    kind[words.unit[ids] & after_number] = UNIT
    return raw, np.where(kind == LITERAL, raw, _PLACE[kind]), kind, lengths


def window_hashes(codes: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Polynomial hash of each window of ``size`` codes; empty if there are fewer."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, salt * 1000 + size, np.uint64)
    for j in range(size):
        h = (h ^ codes[j:j + n]) * _FACTOR
        h ^= h >> np.uint64(29)
    return h


def views(encoded: tuple, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window hashes of the token view and of the template view, which windows lie in one text, and which of them hold enough words."""
    raw, typed, kind, lengths = encoded
    n = max(0, len(raw) - size + 1)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(raw))
    inside = room[:n] >= size
    literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    enough = inside & (2 * (literal[size:size + n] - literal[:n]) >= size)
    return window_hashes(raw, size, 1), window_hashes(typed, size, 2), inside, enough


def slots(tokens: list[str], kinds: np.ndarray) -> list[str]:
    """Values in the placeholders of a window, in order."""
    return [t.lower() for t, kind in zip(tokens, kinds, strict=True) if kind != LITERAL]


def item_windows(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Rows (hash, item_id, at, size, n_tokens, slots) of all windows; an item shorter than WINDOW is one window."""
    rows, kind = keyed(items, item_col, text_col)
    rows = rows.withColumnRenamed("doc_id", "item_id")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for frame in frames:
            out = []
            for item, text in zip(frame["item_id"], frame["text"], strict=True):
                tokens = _tokens(text)
                if len(tokens) < SHORTEST:
                    continue
                size = min(WINDOW, len(tokens))
                encoded = encode([tokens], words)
                plain, typed, _, enough = views(encoded, size)
                for at in range(len(plain)):
                    out.append((int(plain[at].view(np.int64)), item, at, size, len(tokens), []))
                    if enough[at]:
                        out.append((int(typed[at].view(np.int64)), item, at, size, len(tokens), slots(tokens[at:at + size], encoded[2][at:at + size])))
            yield pd.DataFrame(out, columns=["hash", "item_id", "at", "size", "n_tokens", "slots"])

    return unkeyed(rows.mapInPandas(batches, "hash long, item_id string, at int, size int, n_tokens int, slots array<string>"), kind, "item_id")


def document_windows(docs: DataFrame, sizes: list[int], wanted: np.ndarray | None) -> DataFrame:
    """Rows (doc_id, text_key, hash, doc_at, doc_slots) of windows whose hash is in ``wanted``, or of all windows if it is None."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, known = Words(), shared.value
        if known is not None:
            mask = np.uint64((1 << max(16, (64 * (len(known) + 1)).bit_length())) - 1)
            present = np.zeros(int(mask) + 1, bool)
            present[known & mask] = True

        def wanted_windows(hashes: np.ndarray, usable: np.ndarray) -> np.ndarray:
            if known is None:
                return np.flatnonzero(usable)
            at = np.flatnonzero(present[hashes & mask] & usable)
            return at[known[np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)] == hashes[at]] if len(known) else at[:0]

        for frame in frames:
            if not len(frame):
                continue
            for _, piece in frame.groupby(frame["text"].str.len().to_numpy().cumsum() // BATCH_CHARS):
                lists = [_tokens(t) for t in piece["text"]]
                encoded = encode(lists, words)
                begin = np.cumsum(encoded[3]) - encoded[3]
                docs_, keys = piece["doc_id"].tolist(), piece["text_key"].tolist()
                out = []
                for size in sizes:
                    plain, typed, inside, enough = views(encoded, size)
                    for hashes, at, typed_view in ((plain, wanted_windows(plain, inside), False), (typed, wanted_windows(typed, enough), True)):
                        owner = np.searchsorted(begin, at, "right") - 1
                        for i, k in zip(at.tolist(), owner.tolist(), strict=True):
                            first = i - int(begin[k])
                            values = slots(lists[k][first:first + size], encoded[2][i:i + size]) if typed_view else []
                            out.append((docs_[k], keys[k], int(hashes[i].view(np.int64)), first, values))
                yield pd.DataFrame(out, columns=["doc_id", "text_key", "hash", "doc_at", "doc_slots"])

    return docs.mapInPandas(batches, "doc_id string, text_key long, hash long, doc_at int, doc_slots array<string>")


def contained(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """Rows (doc_id, text_key, item_id, covered) of contained items."""
    index = materialise(item_windows(items, item_col, item_text).dropDuplicates(["hash", "item_id", "at"]))
    sizes = sorted({r["size"] for r in index.select("size").distinct().collect()})
    few = index.select("hash").distinct()
    n = few.count()
    wanted = np.sort(np.array([r["hash"] for r in few.collect()], dtype=np.int64).view(np.uint64)) if n <= FILTER_WINDOWS else None
    texts, kind = keyed(docs, id_col, text_col)
    found = unkeyed(document_windows(texts.withColumn("text_key", F.xxhash64("text")), sizes, wanted), kind).distinct().join(index, "hash")
    pairs = F.arrays_zip(F.col("slots").alias("b"), F.col("doc_slots").alias("d"))
    aligned = found.where(F.size("slots") == F.size("doc_slots")).groupBy("doc_id", "text_key", "item_id", (F.col("doc_at") - F.col("at")).alias("shift")).agg(
        F.array_distinct(F.flatten(F.collect_list(pairs))).alias("pairs"), F.collect_set("at").alias("at"),
        F.collect_set(F.when(F.size("slots") == 0, F.col("at"))).alias("verbatim"), F.first("size").alias("size"), F.first("n_tokens").alias("n_tokens"),
    )
    # Windows without slots match as they are; a conflict of slots takes only the template windows of the alignment away.
    one_to_one = (F.size(F.array_distinct("pairs.b")) == F.size("pairs")) & (F.size(F.array_distinct("pairs.d")) == F.size("pairs"))
    merged = aligned.withColumn("at", F.when(one_to_one, F.col("at")).otherwise(F.col("verbatim"))).groupBy("doc_id", "text_key", "item_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"), F.first("size").alias("size"), F.first("n_tokens").alias("n_tokens"),
    )
    tokens = F.aggregate("at", F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n")), lambda a, x: F.struct(
        (x + F.col("size")).alias("end"), (a["n"] + F.col("size") - F.greatest(F.lit(0), a["end"] - x)).alias("n"),
    ))["n"]
    covered = tokens / F.col("n_tokens")
    return merged.select("doc_id", "text_key", "item_id", covered.alias("covered")).where(F.col("covered") >= COVERED)


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, items (ascending), covered (the largest share of an item).

    A null text counts as empty and contains nothing, as does an empty benchmark. Items of fewer
    than SHORTEST tokens are in no document by definition; an item of fewer than WINDOW tokens
    is one window. Rows that repeat id and text get the same answer, rows that share an id but
    not the text their own.
    """
    leaks = contained(docs, items, id_col, text_col, item_col, item_text).groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("covered").alias("covered"))
    leaks = materialise(leaks).select(F.col("doc_id").alias("l_id"), F.col("text_key").alias("l_key"), "items", "covered")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_key"))
    return rows.join(leaks, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("text_key") == F.col("l_key")), "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"),
        F.coalesce("items", F.array().cast(leaks.schema["items"].dataType)).alias("items"), F.coalesce("covered", F.lit(0.0)).alias("covered"),
    )


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with their own columns."""
    leaks = materialise(contained(docs, items, id_col, text_col, item_col, item_text).select("doc_id", "text_key").distinct())
    leak_id, leak_key = unused(docs, "_leak_id"), unused(docs, "_leak_key")
    leaks = leaks.select(F.col("doc_id").alias(leak_id), F.col("text_key").alias(leak_key))
    own = unused(docs, "_key")
    named = docs.withColumn(own, F.xxhash64(text_of(text_col)))
    return without(named, own, leaks, leak_key, F.col(id_col).eqNullSafe(F.col(leak_id))).select(docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
