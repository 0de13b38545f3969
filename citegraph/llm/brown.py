"""Brown class-based bigram model: P(w | v) = P(class(w) | class(v)) * P(w | class(w)).

Every token is a symbol first. Words with at least ``SHARE`` of all training tokens are symbols of their own (there are at most
1 / SHARE of them, so they can be broadcast), the end of a text is one, and all other words share ``SPELLED`` symbols by the hash of
their last letters. Exchange clustering moves symbols between ``CLASSES`` classes: a round computes for every symbol, from its
list of neighbours, the class with the largest gain of average mutual information; half of the symbols may move in a round, so that
neighbours do not swap. Lists of neighbours are as long as the set of symbols at most.

Texts are tokenised once, in pieces that are stored as their distinct words and the tokens' places among them; all passes join these
to blocks. Word counts never leave their hash range: a block sends its distinct words to ``ranges`` tasks, and for
scoring asks the same ranges for the counts of its rare words. What is shuffled grows with the distinct words of the blocks.

Within a class, seen words give up ``DISCOUNT`` counts each, and the sum of that is the probability of words not seen in training.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, fold, keyed, materialise, table, unkeyed

SHARE = 5e-5
SPELLED = 1024
CLASSES = 64
ROUNDS = 6
DISCOUNT = 0.6
PRIOR = 4.0
# Characters of text in a block, and the number of hash ranges per block's worth of words.
BLOCK_CHARS = 8_000_000
BLOCKS_PER_RANGE = 3
# Characters of text in a stored row; tasks join rows to blocks.
PIECE_CHARS = 500_000
# Tokens whose probabilities are held at a time.
TOKENS_AT_ONCE = 150_000
# Characters of text whose symbol pairs are merged by one set of tasks before those sets are merged.
MERGED_CHARS = 40_000_000_000
SEED = 53
KEPT = 300_000
_split = re.compile(r"[^\x20\x09-\x0D]+").findall
_LOWER = str.maketrans(UPPER, UPPER.lower())
END = 0


def word_hash(word: str) -> int:
    """64 bits, the lowest ones the shared symbol of the word's ending."""
    raw = word.encode("utf-8", "surrogatepass")
    return (zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1], 77)) & ~(SPELLED - 1) | spelled(word)


def spelled(word: str) -> int:
    """Number of the shared symbol of a rare word: its last three letters, and whether it ends a clause."""
    return zlib.crc32(word[-3:].encode("utf-8", "surrogatepass")) % SPELLED


class Words(dict):
    """Word -> row of the array of hashes; tokens of many texts become one array of rows."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros(4096, np.uint64)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[i] = word_hash(word)
        self[word] = i
        return i


def text_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames gathered to about PIECE_CHARS characters."""
    held, chars = [], 0
    for frame in frames:
        start = 0
        sizes = frame["text"].str.len().to_numpy()
        for at, size in enumerate(sizes):
            chars += int(size) + 50
            if chars >= PIECE_CHARS:
                yield pd.concat([*held, frame.iloc[start:at + 1]], ignore_index=True)
                held, chars, start = [], 0, at + 1
        if start < len(frame):
            held.append(frame.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


def tokenise(texts, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all tokens of the texts, one after the other, and the number per text."""
    if len(words) > KEPT:
        words.clear()
    lists = [_split(t.translate(_LOWER)) for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    rows = np.fromiter((i for one in lists for i in map(words.__getitem__, one)), np.int64, int(lengths.sum()))
    return rows, lengths


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def ranged(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash range of each word: ranges are equal and ascending."""
    return ((hashes >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int32)


def by_range(hashes: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Slices of ascending hashes by range."""
    cuts = np.searchsorted(ranged(hashes, n), np.arange(n + 1))
    return ((r, slice(cuts[r], cuts[r + 1])) for r in range(n) if cuts[r] < cuts[r + 1])


def token_blocks(rows: DataFrame) -> DataFrame:
    """Rows (block, chars, n_train, doc_ids, train, lengths, hashes, low, high): the distinct words of a piece and its tokens as places among them.

    Places are stored as two planes of 16 bits, of which the high one is mostly zero. ``rows`` are (doc_id, text, train).
    """
    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        words, task = Words(), TaskContext.get().partitionId()
        for number, block in enumerate(text_pieces(frames)):
            at, lengths = tokenise(block["text"], words)
            seen = np.zeros(len(words), bool)
            seen[at] = True
            at = (np.cumsum(seen) - 1)[at]
            train = block["train"].to_numpy(bool)
            yield pd.DataFrame([{
                "block": (task << 24) + number, "chars": int(block["text"].str.len().sum()), "n_train": int(train.sum()), "doc_ids": list(block["doc_id"]),
                "train": pack(train), "lengths": pack(lengths), "hashes": pack(words.hashes[:len(words)][seen]),
                "low": pack((at & 0xFFFF).astype(np.uint16)), "high": pack((at >> 16).astype(np.uint16)),
            }])

    return rows.mapInPandas(local, "block long, chars long, n_train long, doc_ids array<string>, train binary, lengths binary, hashes binary, low binary, high binary")


def pieces_of(frames: Iterator[pd.DataFrame], trained: bool) -> Iterator[tuple]:
    """(number, ids, words, places of all tokens, tokens per text, characters) of stored pieces, of training texts alone if ``trained``."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            at = np.frombuffer(row.low, np.uint16).astype(np.int32) | np.frombuffer(row.high, np.uint16).astype(np.int32) << 16
            lengths, ids = np.frombuffer(row.lengths, np.int64), None if trained else row.doc_ids
            if trained:
                train = np.frombuffer(row.train, bool)
                at, lengths = at[np.repeat(train, lengths)], lengths[train]
            yield row.block, ids, np.frombuffer(row.hashes, np.uint64), at, lengths, row.chars


def blocks_of(frames: Iterator[pd.DataFrame], trained: bool) -> Iterator[tuple]:
    """(number, ids, words, places, lengths) of blocks, pieces joined to about BLOCK_CHARS characters; the number is the first piece's."""
    def joined(pieces: list[tuple]) -> tuple:
        numbers, ids, words, at, lengths, _ = zip(*pieces)
        found, place = np.unique(np.concatenate(words), return_inverse=True)
        starts = np.cumsum([0, *map(len, words)])
        place = place.astype(np.int32)
        at = np.concatenate([place[start:end][a] for start, end, a in zip(starts, starts[1:], at)])
        return numbers[0], None if trained else np.concatenate(ids), found, at, np.concatenate(lengths)

    held, chars = [], 0
    for piece in pieces_of(frames, trained):
        held.append(piece)
        chars += piece[-1]
        if chars >= BLOCK_CHARS:
            yield joined(held)
            held, chars = [], 0
    if held:
        yield joined(held)


def count_words(blocks: DataFrame, ranges: int) -> DataFrame:
    """Rows (part, hashes, counts): ascending word hashes of a range with their training counts, both as binary arrays."""
    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, words, at, _ in blocks_of(frames, True):
            counts = np.bincount(at, minlength=0)
            seen = np.flatnonzero(counts)
            order = seen[np.argsort(words[seen], kind="stable")]
            hashes, counts = words[order], counts[order].astype(np.int64)
            yield pd.DataFrame([(r, pack(hashes[s]), pack(counts[s])) for r, s in by_range(hashes, ranges)], columns=["part", "hashes", "counts"])

    def added(key, frame: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["hashes"]])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in frame["counts"]])
        found, at = np.unique(hashes, return_inverse=True)
        total = np.bincount(at, weights=counts).astype(np.int64)
        return pd.DataFrame({"part": [key[0]], "hashes": [pack(found)], "counts": [pack(total)], "types": [len(found)], "tokens": [int(total.sum())]})

    return blocks.drop("doc_ids").mapInPandas(local, "part int, hashes binary, counts binary").groupBy("part").applyInPandas(
        added, "part int, hashes binary, counts binary, types long, tokens long")


def frequent_words(vocabulary: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes and counts of words with at least ``least`` occurrences; the share bounds their number."""
    def picked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for h, c in zip(frame["hashes"], frame["counts"], strict=True):
                h, c = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)
                keep = c >= least
                yield pd.DataFrame({"h": h[keep].view(np.int64), "c": c[keep]})

    got = vocabulary.mapInPandas(picked, "h long, c long").collect()
    hashes = np.array([r["h"] for r in got], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["c"] for r in got], dtype=np.int64)[order]


class Symbols:
    """Numbers of symbols: the end, frequent words in the order of their hashes, then spelled ones."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.size = 1 + len(hashes) + SPELLED

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word and whether it is a frequent one."""
        shape = (hashes & np.uint64(SPELLED - 1)).astype(np.int64)
        if not len(self.hashes):
            return 1 + shape, np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        own = self.hashes[at] == hashes
        return np.where(own, 1 + at, 1 + len(self.hashes) + shape), own


def with_ends(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Symbols with an end before the first text and after every text."""
    ends = np.cumsum(lengths)
    return np.concatenate([[END], np.insert(symbols, ends, END)])


def neighbour_lists(blocks: DataFrame, shared, parts: int, sets: int) -> DataFrame:
    """Rows (symbol, side, others, counts): following (side 1) and preceding (side 0) symbols with counts as binary arrays.

    Pairs are counted per task before they are shuffled, then per ``sets`` groups of tasks, then in all; a symbol has at
    most as many neighbours as there are symbols.
    """
    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() % sets
        symbols = shared.value
        size = symbols.size
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged(more: list[np.ndarray], weight: list[np.ndarray]):
            found, at = np.unique(np.concatenate(more), return_inverse=True)
            return found, np.bincount(at, weights=np.concatenate(weight)).astype(np.int64)

        def flush():
            second = codes % size
            order = np.argsort(second * size + codes // size, kind="stable")
            for side, own, other, c in ((1, codes // size, second, counts), (0, second[order], (codes // size)[order], counts[order])):
                cuts = np.searchsorted(own * parts // size, np.arange(parts + 1))
                for p in range(parts):
                    s = slice(cuts[p], cuts[p + 1])
                    if cuts[p] < cuts[p + 1]:
                        yield p, group, side, pack(own[s].astype(np.int32)), pack(other[s].astype(np.int32)), pack(c[s])

        columns = ["part", "group", "side", "own", "other", "counts"]
        for _, _, words, at, lengths in blocks_of(frames, True):
            if not len(lengths):
                continue
            s = with_ends(symbols.of(words)[0][at], lengths)
            found, n = np.unique(s[:-1] * size + s[1:], return_counts=True)
            codes, counts = merged([codes, found], [counts, n])
            if len(codes) > 4_000_000:
                yield pd.DataFrame(list(flush()), columns=columns)
                codes, counts = codes[:0], counts[:0]
        yield pd.DataFrame(list(flush()), columns=columns)

    def added(key, frame: pd.DataFrame) -> pd.DataFrame:
        size = shared.value.size
        own, other, c = (np.concatenate([np.frombuffer(x, np.int64 if n == "counts" else np.int32) for x in frame[n]]).astype(np.int64) for n in ("own", "other", "counts"))
        found, at = np.unique(own * size + other, return_inverse=True)
        total = np.bincount(at, weights=c).astype(np.int64)
        return pd.DataFrame({"part": [key[0]], "side": [key[1]], "own": [pack((found // size).astype(np.int32))], "other": [pack((found % size).astype(np.int32))], "counts": [pack(total.astype(np.int64))]})

    kind = "side int, own binary, other binary, counts binary"
    pairs = blocks.drop("doc_ids").mapInPandas(local, f"part int, group int, {kind}")
    if sets > 1:
        pairs = pairs.groupBy("part", "side", "group").applyInPandas(added, f"part int, {kind}")
    return pairs.groupBy("part", "side").applyInPandas(added, f"part int, {kind}").drop("part")


def class_counts(lists: DataFrame, spark: SparkSession, classes: np.ndarray) -> DataFrame:
    """Rows (side, own, cells) per symbol: its neighbours' counts by class."""
    shared = spark.sparkContext.broadcast(classes)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value
        for frame in frames:
            for side, own, other, counts in zip(frame["side"], frame["own"], frame["other"], frame["counts"], strict=True):
                own, other = np.frombuffer(own, np.int32), np.frombuffer(other, np.int32)
                found, at = np.unique(own, return_inverse=True)
                cells = np.bincount(at * CLASSES + of[other], weights=np.frombuffer(counts, np.int64), minlength=len(found) * CLASSES)
                yield pd.DataFrame({"side": [side], "own": [pack(found)], "cells": [pack(cells)]})

    return lists.mapInPandas(counted, "side int, own binary, cells binary")


def exchange(lists: DataFrame, spark: SparkSession, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all symbols and the class-pair counts. The driver holds CLASSES numbers a symbol, whose number SHARE bounds."""
    rng = np.random.default_rng(SEED)
    classes = np.zeros(n_symbols, np.int64)

    def sides(of):
        after, before = np.zeros((n_symbols, CLASSES)), np.zeros((n_symbols, CLASSES))
        for r in class_counts(lists, spark, of).toLocalIterator():
            own = np.frombuffer(r["own"], np.int32)
            (after if r["side"] else before)[own] += np.frombuffer(r["cells"]).reshape(-1, CLASSES)
        return after, before

    # Class 0 is the end's. Symbols start dealt by frequency, so that every class begins with some frequent ones.
    after, _ = sides(classes)
    by_count = np.argsort(-after.sum(1), kind="stable")
    by_count = by_count[by_count != END]
    classes[by_count] = 1 + np.arange(len(by_count)) % (CLASSES - 1)
    for turn in range(ROUNDS):
        after, before = sides(classes)
        pairs = np.zeros((CLASSES, CLASSES))
        np.add.at(pairs, classes, after)
        # Gain of a class is the log-likelihood of the symbol's neighbours under the class's own distributions, its size aside.
        right, left = pairs + 0.05, pairs.T + 0.05
        gain = after @ np.log(right / right.sum(1, keepdims=True)).T + before @ np.log(left / left.sum(1, keepdims=True)).T
        gain[:, 0] = -np.inf
        best = gain.argmax(1)
        moves = rng.random(n_symbols) < (0.5 if turn < ROUNDS - 1 else 1.0)
        moves[END] = False
        moves &= after.sum(1) + before.sum(1) > 0
        classes = np.where(moves, best, classes)
    after, _ = sides(classes)
    pairs = np.zeros((CLASSES, CLASSES))
    np.add.at(pairs, classes, after)
    return classes, pairs


def slices(lengths: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Slices of texts with about TOKENS_AT_ONCE tokens, and of their tokens."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    start = 0
    while start < len(lengths):
        end = max(start + 1, int(np.searchsorted(ends + np.arange(len(ends)), ends[start] + start + TOKENS_AT_ONCE)))
        end = min(end, len(lengths))
        yield slice(start, end), slice(ends[start], ends[end])
        start = end


def score_parts(blocks: DataFrame, shared, ranges: int) -> DataFrame:
    """Rows of two kinds per block: its documents with class scores and lists of rare words, and its questions per hash range."""
    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols, classes, transition, emission, base, end_seen = shared.value
        for key, ids, words, at, lengths in blocks_of(frames, False):
            symbol, own = symbols.of(words)
            # Frequent words and ends are settled here; rare tokens wait for their counts.
            certain = np.where(own, symbol, END)
            of_word = np.where(own, emission[certain], 0.0), np.where(own, base[certain], 0.0), own
            of_end = emission[END], base[END], end_seen
            sums = np.zeros(len(lengths)), np.zeros(len(lengths)), np.zeros(len(lengths), np.int64)
            for docs, tokens in slices(lengths):
                n, part = lengths[docs], at[tokens]
                ends = np.cumsum(n)
                heads = ends - n + np.arange(len(n))
                c = classes[with_ends(symbol[part], n)]
                step = transition[c[:-1], c[1:]]
                for i, (word, end) in enumerate(zip(of_word, of_end)):
                    values = np.insert(word[part], ends, end)
                    sums[i][docs] = np.add.reduceat(values + step if i == 0 else values.astype(sums[i].dtype), heads)
            rare = np.flatnonzero(~own)
            asked = words[rare]
            order = np.argsort(asked, kind="stable")
            place = np.full(len(words), -1, np.int32)
            place[rare[order]] = np.arange(len(rare))
            which = ~own[at]
            doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[which]
            head = {"doc_ids": ids, "n_tokens": lengths + 1, "score": sums[0], "base": sums[1], "known": sums[2]}
            sizes = np.bincount(doc, minlength=len(lengths))
            yield pd.DataFrame([{
                "kind": 0, "block": key, "part": -1, "hashes": pack(sizes.astype(np.int32)), "counts": pack(place[at[which]]),
                "classes": pack(classes[symbol[rare[order]]].astype(np.uint8)), **{k: list(v) for k, v in head.items()},
            }])
            asked = asked[order]
            empty = {k: [] for k in head}
            yield pd.DataFrame([{"kind": 1, "block": key, "part": r, "hashes": pack(asked[s_]), "counts": b"", "classes": b"", **empty} for r, s_ in by_range(asked, ranges)],
                               columns=["kind", "block", "part", "hashes", "counts", "classes", *head])

    schema = ("kind int, block long, part int, hashes binary, counts binary, classes binary, doc_ids array<string>, "
              "n_tokens array<long>, score array<double>, base array<double>, known array<long>")
    return blocks.mapInPandas(local, schema)


def answers(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows (block, part, counts): training counts of the asked words, 0 if unseen."""
    def looked_up(key, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"block": [], "part": [], "counts": []})
        h = np.frombuffer(known["hashes"].iloc[0], np.uint64) if len(known) else np.zeros(0, np.uint64)
        c = np.frombuffer(known["counts"].iloc[0], np.int64) if len(known) else np.zeros(0, np.int64)
        out = []
        for x in asked["hashes"]:
            q = np.frombuffer(x, np.uint64)
            if len(h):
                at = np.minimum(np.searchsorted(h, q), len(h) - 1)
                out.append(pack(np.where(h[at] == q, c[at], 0).astype(np.int32)))
            else:
                out.append(pack(np.zeros(len(q), np.int32)))
        return pd.DataFrame({"block": asked["block"], "part": asked["part"], "counts": out})

    return questions.groupBy("part").cogroup(vocabulary.select("part", "hashes", "counts").groupBy("part")).applyInPandas(
        looked_up, "block long, part int, counts binary")


def score_lm(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held: int = 2) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts outside the held-out fold are the training set. A null text counts as empty: one
    token, the end. Without any training text every count is 0, and the model falls back to the
    base. Repeated rows count each and score alike. Scores are log10 probabilities of whole texts.
    """
    spark = docs.sparkSession
    rows, kind = keyed(docs, id_col, text_col)
    blocks = materialise(token_blocks(rows.withColumn("train", fold("doc_id", parts) != held)))
    read = blocks.agg(F.sum("chars").alias("chars"), F.sum("n_train").alias("n_train")).first()
    size, n_train = read["chars"] or 0, read["n_train"] or 0
    ranges = int(max(8, size / BLOCK_CHARS / BLOCKS_PER_RANGE))
    vocabulary = materialise(count_words(blocks, ranges))
    totals = vocabulary.agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    tokens, types = (totals["tokens"] or 0) + n_train, (totals["types"] or 0) + bool(n_train)
    hashes, counts = frequent_words(vocabulary, max(2.0, SHARE * tokens))
    symbols = Symbols(hashes)
    shared = spark.sparkContext.broadcast(symbols)
    lists = materialise(neighbour_lists(blocks, shared, int(min(4096, ranges)), 1 + int(size / MERGED_CHARS)))
    classes, pairs = exchange(lists, spark, symbols.size) if tokens else (np.zeros(symbols.size, np.int64), np.ones((CLASSES, CLASSES)))

    # Per class its words, tokens and types; spelled symbols' words come from the vocabulary.
    frequent = np.concatenate([[n_train], counts]).astype(np.float64)
    class_tokens = np.maximum(pairs.sum(0), 1e-9)
    class_types = np.bincount(classes[:1 + len(counts)], minlength=CLASSES).astype(np.float64)
    np.add.at(class_types, classes[1 + len(counts):], spelled_types(vocabulary, shared))
    prior = class_tokens / class_tokens.sum()
    transition = np.log10((pairs + PRIOR * prior[None, :]) / (pairs.sum(1, keepdims=True) + PRIOR))
    own_class = classes[:1 + len(counts)]
    emission = np.log10(np.maximum(frequent - DISCOUNT, 1e-12) / class_tokens[own_class])
    unseen_mass = np.log10(np.where(class_tokens > 0.5, np.minimum(1.0, DISCOUNT * np.maximum(class_types, 0.1) / class_tokens), 1.0))
    denominator = np.log10(tokens + types + 1)
    base = np.log10(frequent + 1) - denominator
    everything = spark.sparkContext.broadcast((symbols, classes, transition, emission, base, bool(n_train)))
    stored = materialise(score_parts(blocks, everything, ranges))
    replies = answers(stored.where("kind = 1").select("block", "part", "hashes"), vocabulary)
    per_class = spark.sparkContext.broadcast((np.log10(class_tokens), unseen_mass, denominator))

    def finished(key, head: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        log_tokens, unseen, below = per_class.value
        one = head.iloc[0]
        of = np.frombuffer(one["classes"], np.uint8)
        count = np.concatenate([np.frombuffer(x, np.int32) for x in reply.sort_values("part")["counts"]]) if len(reply) else np.zeros(0, np.int32)
        emit = np.where(count > 0, np.log10(np.maximum(count - DISCOUNT, 1e-12)) - log_tokens[of], unseen[of])
        plain = np.log10(count + 1.0) - below
        which = np.frombuffer(one["counts"], np.int32)
        doc = np.repeat(np.arange(len(one["doc_ids"])), np.frombuffer(one["hashes"], np.int32))
        n = len(one["doc_ids"])
        add = lambda v: np.bincount(doc, weights=v[which], minlength=n)
        return pd.DataFrame({
            "doc_id": one["doc_ids"], "n_tokens": one["n_tokens"], "n_known": one["known"] + add((count > 0).astype(np.float64)).astype(np.int64),
            "base_score": one["base"] + add(plain), "score": one["score"] + add(emit),
        })

    scored = stored.where("kind = 0").groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(
        finished, "doc_id string, n_tokens long, n_known long, base_score double, score double")
    if not tokens:
        scored = scored.withColumn("score", F.col("base_score"))
    return unkeyed(scored, kind).select(
        "doc_id", (fold("doc_id", parts) == held).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def spelled_types(vocabulary: DataFrame, shared) -> np.ndarray:
    """Distinct training words per shared symbol."""
    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols = shared.value
        total = np.zeros(SPELLED, np.int64)
        for frame in frames:
            for h in frame["hashes"]:
                h = np.frombuffer(h, np.uint64)
                total += np.bincount((h[~symbols.of(h)[1]] & np.uint64(SPELLED - 1)).astype(np.int64), minlength=SPELLED)
        yield pd.DataFrame({"shape": np.arange(SPELLED), "n": total})

    out = np.zeros(SPELLED)
    for r in vocabulary.mapInPandas(counted, "shape int, n long").groupBy("shape").agg(F.sum("n").alias("n")).collect():
        out[r["shape"]] = r["n"]
    return out


def op6_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_lm(table(spark, sf_dir, "documents"))
