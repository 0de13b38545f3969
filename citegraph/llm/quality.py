"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

One pass over the texts gives ``STATISTICS`` per document. Standardised statistics go through D random cosines, which
approximate a Gaussian kernel; each task sums Z'Z and Z'y of its labelled rows, a few tasks add those sums, and the ridge
system of D unknowns is solved once. Scores of labelled rows, counted on a grid, give the isotonic curve that turns a score
into a probability. Work at the driver depends on D and the grid only, never on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, keyed, materialise, table, text_of, unkeyed

FEATURES = 384
WIDTH = 3.5
RIDGE = 1.0
GRID = 1000
FANIN = 16
SEED = 29
THRESHOLD = 0.7
STATISTICS = (
    "log_chars", "word_length", "upper", "upper_most", "odd", "odd_most", "digits", "digits_most", "echo", "echo_most",
    "bigrams", "bigrams_least", "distinct", "distinct_least", "lines", "lines_repeated", "long_words", "stops",
)
# Byte classes of the statistics.
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
_ODD = np.zeros(256, np.uint8)
_ODD[[ord(c) for c in "!#$%&*+/<=>@\\^_`{|}~[]"]] = 1
_BLOCK_BYTES, _BLOCK_WORDS = 256, 48


def _most(mask: np.ndarray) -> tuple[float, float]:
    """Share of set bytes in all and in the block with the largest share."""
    n = len(mask)
    if n == 0:
        return 0.0, 0.0
    sums = np.add.reduceat(mask, np.arange(0, n, _BLOCK_BYTES), dtype=np.int64)
    size = np.full(len(sums), _BLOCK_BYTES)
    size[-1] = max(n - _BLOCK_BYTES * (len(sums) - 1), _BLOCK_BYTES // 4)
    return float(sums.sum()) / n, float((sums / size).max())


def statistics(text: str) -> list[float]:
    """The document's statistics; shares lie in 0..1 and an empty text has none of anything."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    words = text.split()
    n = len(words)
    upper, digits, odd = (_most(table[raw]) for table in (_UPPER, _DIGIT, _ODD))
    if n:
        ids = {}
        codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        echo = (codes[1:] == codes[:-1]).astype(np.float64)
        pairs = codes[1:] * n + codes[:-1]
        bigrams = len(np.unique(pairs)) / max(1, n - 1)
        parts = range(0, n, _BLOCK_WORDS)
        tails = [i for i in parts if n - i >= _BLOCK_WORDS // 2 or i == 0]
        least_pairs = min(len(set(pairs[i:i + _BLOCK_WORDS].tolist())) / max(1, len(pairs[i:i + _BLOCK_WORDS])) if len(pairs[i:i + _BLOCK_WORDS]) else 1.0 for i in tails)
        least = min(len(set(codes[i:i + _BLOCK_WORDS].tolist())) / len(codes[i:i + _BLOCK_WORDS]) for i in tails)
        most_echo = max(float(echo[i:i + _BLOCK_WORDS].mean()) if len(echo[i:i + _BLOCK_WORDS]) else 0.0 for i in tails)
        distinct, mean_echo = len(ids) / n, float(echo.mean()) if n > 1 else 0.0
        sizes = np.fromiter(map(len, words), np.int64, n)
        length, long_words, stops = float(sizes.mean()), float((sizes > 15).mean()), float((sizes <= 3).mean())
    else:
        bigrams = least_pairs = distinct = least = 1.0
        mean_echo = most_echo = length = long_words = stops = 0.0
    lines = text.split("\n")
    repeated = 1.0 - len(set(lines)) / len(lines)
    return [
        float(np.log1p(len(text))), length, *upper, *odd, *digits, mean_echo, most_echo, bigrams, least_pairs, distinct, least,
        float(np.log1p(len(lines))), repeated, long_words, stops,
    ]


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, stats), one per input row."""
    rows, kind = keyed(docs, id_col, text_col)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "stats": [statistics(t) for t in frame["text"]]})

    return unkeyed(rows.mapInPandas(batches, "doc_id string, stats array<double>"), kind)


class Model:
    """Standardisation, cosine features, ridge weights and the isotonic curve."""

    def __init__(self, mean, scale, seed: int = SEED, features: int = FEATURES, width: float = WIDTH):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.knots, self.levels = np.array([0.0]), np.array([0.5])

    def expand(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2.0 / self.w.shape[1])
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.expand(stats) @ self.weights, -0.5, 1.5)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0.0, 1.0)


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, len(STATISTICS)))


def normal_equations(labelled: DataFrame, model: Model) -> np.ndarray:
    """Sum over rows of z z' with the label as last component: per task, then per FANIN groups of tasks, then in one sum."""
    size = len(model.weights) + 1

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((size, size)), False
        for frame in frames:
            if len(frame):
                z = np.hstack([model.expand(stacked(frame["stats"])), frame[["label"]].to_numpy(np.float64)])
                total += z.T @ z
                seen = True
        if seen:
            yield pd.DataFrame({"cells": [total.tobytes()]})

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for frame in frames:
            for cells in frame["cells"]:
                total += np.frombuffer(cells).reshape(size, size)
        yield pd.DataFrame({"cells": [total.tobytes()]})

    sums = labelled.mapInPandas(partial, "cells binary").repartition(FANIN).mapInPandas(added, "cells binary").collect()
    return sum((np.frombuffer(r["cells"]).reshape(size, size) for r in sums), np.zeros((size, size)))


def isotonic(score: np.ndarray, positives: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing shares of positives."""
    blocks: list[list[float]] = []
    for s, p, t in zip(score, positives, totals, strict=True):
        blocks.append([s * t, p, t])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(labelled: DataFrame) -> Model:
    """Model from rows (stats, label 0/1); without any row it scores 0.5 everywhere."""
    n = len(STATISTICS)
    moments = labelled.select(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(n)], *[F.sum(F.col("stats")[i] ** 2).alias(f"q{i}") for i in range(n)],
    ).first()
    rows = moments["n"]
    if not rows:
        return Model(np.zeros(n), np.ones(n))
    mean = np.array([moments[f"s{i}"] for i in range(n)]) / rows
    scale = np.sqrt(np.maximum(np.array([moments[f"q{i}"] for i in range(n)]) / rows - mean**2, 1e-6))
    model = Model(mean, scale)
    sums = normal_equations(labelled, model)
    a, y = sums[:-1, :-1], sums[:-1, -1]
    penalty = np.full(len(a), RIDGE)
    penalty[-1] = 1e-6
    model.weights = np.linalg.solve(a + np.diag(penalty), y)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"cell": np.round(model.raw(stacked(frame["stats"])) * GRID).astype("int64"), "label": frame["label"]})

    # At most 2 * GRID + 1 cells, since raw scores are clipped to -0.5..1.5.
    cells = sorted(labelled.mapInPandas(scored, "cell long, label int").groupBy("cell").agg(
        F.sum("label").alias("p"), F.count(F.lit(1)).alias("t")).collect(), key=lambda r: r["cell"])
    model.knots, model.levels = isotonic(*np.array([(r["cell"] / GRID, r["p"], r["t"]) for r in cells], dtype=np.float64).T)
    return model


def apply_model(described: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score) of described rows."""
    kind = described.schema["doc_id"].dataType.simpleString()
    kept = described.select(F.col("doc_id").cast("string"), "stats")

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["doc_id"]].assign(score=model.score(stacked(frame["stats"])))

    return unkeyed(kept.mapInPandas(scored, "doc_id string, score double"), kind)


def labelled_rows(described: DataFrame, labels: DataFrame, label_col: str, parts: int, held: int) -> DataFrame:
    """Described rows of the learning folds with their label; ids that are null or unlabelled have none."""
    marks = labels.select(F.col("doc_id").alias("l_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    return described.where(fold("doc_id", parts) != held).join(marks, F.col("doc_id") == F.col("l_id")).select("stats", "label")


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    parts: int = 4, held: int = 2, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels are read for documents outside the held-out fold only. A null text counts as empty
    and gets the score of the empty text; repeated rows get the same score; with no labels all
    scores are 0.5. Columns other than id and text are not read.
    """
    described = materialise(describe(docs, id_col, text_col))
    model = fit(labelled_rows(described, labels, label_col, parts, held))
    return apply_model(described, model).select(
        "doc_id", (fold("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    parts: int = 4, held: int = 2, threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with their own columns.

    The model is fitted as in ``score_quality``. Its score is a column expression, so statistics
    are taken twice, but no text is shuffled and rows that share an id are judged by their texts.
    """
    described = materialise(describe(docs, id_col, text_col))
    model = fit(labelled_rows(described, labels, label_col, parts, held))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            yield pd.Series(model.score(np.array([statistics(t) for t in column], dtype=np.float64).reshape(-1, len(STATISTICS))))

    return docs.where(score(text_of(text_col)) >= threshold)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
