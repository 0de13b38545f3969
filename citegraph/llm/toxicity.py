"""Toxic spans by a linear-chain conditional random field of two states, clean and toxic.

Learning uses a bounded sample of labelled documents (``SAMPLE_ROWS`` per class, ``SAMPLE_CHARS`` in all). Documents carry one
label, so tokens get theirs first: a token of a toxic document is toxic if one of its surface features is held by far more
toxic documents of the sample than chance explains. Documents are scored by two views of the marginals, the largest one and
the sum of their squares, through a logistic curve fitted to fields that have not seen the document. The field has a weight per hashed surface feature (word, prefixes, suffix), a bias, a
start weight and four transition weights, and is fitted by gradient steps on the penalised log-likelihood.

Scoring is one pass over the texts without a shuffle. The odds toxic : clean of the forward and of the backward recursion pass from
token to token by a Mobius map, so a batch of documents is cut into rows of equal length whose maps are composed column by column;
the recursion then runs over whole columns at once and is exact whatever a document's length.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, keyed, table, unkeyed

SAMPLE_ROWS = 1500
SAMPLE_CHARS = 5_000_000
BUCKETS = 1 << 18
ROUNDS = 25
PENALTY = 1e-3
THRESHOLD = 0.7
SPAN = 0.5
FOLDS = 5
# A surface feature tells from this likelihood ratio statistic and this ratio of rates on.
RATIO_TEST = 9.0
RATE = 6.0
# Surface features of a word.
WIDTH = 6
# Words whose weights a worker keeps; when full the store starts anew.
KEPT = 500_000
# Characters of text scored at a time.
BATCH_CHARS = 4_000_000
COLUMNS = 128
LIMIT = 25.0

_words = re.compile(r"\w+").findall
_spans = re.compile(r"\w+").finditer


def lowered(text: str) -> str:
    """Lower case of the same length: a character whose lower case has several characters stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def features(word: str) -> list[str]:
    """Surface features of a lower-case word."""
    return ["w=" + word, "3=" + word[:3], "4=" + word[:4], "5=" + word[:5], "6=" + word[:6], "e=" + word[-3:]]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def mobius_scan(odds: np.ndarray, step: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """r[t] = odds[t] * (step[1] + r[t-1] * step[3]) / (step[0] + r[t-1] * step[2]), and odds[t] * first at starts.

    ``step`` holds the transition factors clean-clean, clean-toxic, toxic-clean, toxic-toxic.
    """
    n = len(odds)
    rows = -(-n // COLUMNS)
    e = np.ones(rows * COLUMNS)
    e[:n] = odds
    reset = np.zeros(rows * COLUMNS, bool)
    reset[:n][starts] = True
    e, reset = e.reshape(rows, COLUMNS), reset.reshape(rows, COLUMNS)
    # Map of r: (a r + b) / (c r + d).
    ma, mb = np.where(reset, 0.0, e * step[3]), np.where(reset, e * first, e * step[1])
    mc, md = np.where(reset, 0.0, step[2]), np.where(reset, 1.0, step[0])
    a, b, c, d = ma[:, 0].copy(), mb[:, 0].copy(), mc[:, 0].copy(), md[:, 0].copy()
    for j in range(1, COLUMNS):
        a, b, c, d = ma[:, j] * a + mb[:, j] * c, ma[:, j] * b + mb[:, j] * d, mc[:, j] * a + md[:, j] * c, mc[:, j] * b + md[:, j] * d
        scale = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / scale, b / scale, c / scale, d / scale
    heads, r = np.empty(rows), 0.0
    for i in range(rows):
        heads[i] = r
        r = (a[i] * r + b[i]) / (c[i] * r + d[i])
    out, r = np.empty((rows, COLUMNS)), heads
    for j in range(COLUMNS):
        r = (ma[:, j] * r + mb[:, j]) / (mc[:, j] * r + md[:, j])
        out[:, j] = r
    return out.reshape(-1)[:n]


def marginals(unary: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: float) -> np.ndarray:
    """P(toxic) of every token; ``unary`` holds the documents' tokens one after the other."""
    if not len(unary):
        return np.zeros(0)
    return _recursions(unary, lengths, transition, start)[2]


def _recursions(unary, lengths, transition, start):
    """Forward odds, backward odds and marginals."""
    lengths = lengths[lengths > 0]
    ends = np.cumsum(lengths)
    heads = ends - lengths
    odds = np.exp(np.clip(unary, -LIMIT, LIMIT))
    step = np.exp(transition.reshape(4))
    forward = mobius_scan(odds, step, heads, float(np.exp(start)))
    # Backward: g[t] = odds[t] * b[t]; b[t-1] = (step[2] + g[t] step[3]) / (step[0] + g[t] step[1]), b at document ends 1.
    turned = mobius_scan(odds[::-1], step[[0, 2, 1, 3]], len(odds) - ends[::-1], 1.0)[::-1]
    backward = turned / odds
    joint = forward * backward
    return forward, backward, joint / (1.0 + joint)


class Field:
    """Fitted weights; ``clean`` texts score near 0, toxic near 1 through a logistic curve of the marginals' evidence."""

    def __init__(self):
        self.weights: dict[int, float] = {}
        self.bias, self.start = -6.0, 0.0
        self.transition = np.zeros((2, 2))
        self.slopes, self.offset = np.array([1.0, 0.0]), 0.0
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"} | {"known": {}}

    def unary(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        except KeyError:
            pass
        if len(known) > KEPT:
            known.clear()
        weights = self.weights
        for w in set(words).difference(known):
            known[w] = self.bias + sum(weights.get(bucket(f), 0.0) for f in features(w))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """Marginals per token of each text."""
        words = [_words(lowered(t)) for t in texts]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        unary = np.concatenate([self.unary(w) for w in words]) if words else np.zeros(0)
        return np.split(marginals(unary, lengths, self.transition, self.start), np.cumsum(lengths)[:-1])

    def evidence(self, tagged: list[np.ndarray]) -> np.ndarray:
        """Per text the logit of the largest marginal and log(1 + sum of squared marginals).

        Squares count toxic tokens and keep the faint background of a long clean text from adding up.
        """
        most = np.clip([p.max() if len(p) else 0.0 for p in tagged], 1e-9, 1 - 1e-9)
        total = np.array([(p * p).sum() for p in tagged])
        return np.stack([np.clip(np.log(most / (1 - most)), -15, 15), np.log1p(total)], 1).reshape(-1, 2)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(evidence @ self.slopes + self.offset, -40, 40)))


class Tokens:
    """Texts as numbers of words and of hashed features, built once for all fits on parts of them."""

    def __init__(self, texts: list[str]):
        docs = [list(map(sys.intern, _words(lowered(t)))) for t in texts]
        self.lengths = np.array([len(d) for d in docs], dtype=np.int64)
        vocabulary: dict[str, int] = {}
        self.word = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for d in docs for w in d), np.int64, int(self.lengths.sum()))
        self.doc = np.repeat(np.arange(len(docs)), self.lengths)
        self.slots: dict[int, int] = {}
        self.grid = np.array([[self.slots.setdefault(bucket(f), len(self.slots)) for f in features(w)] for w in vocabulary], dtype=np.int64).reshape(-1, WIDTH)
        # Features that may tell: the word itself and prefixes of at least four letters.
        names: dict[str, int] = {}
        self.signs = np.array([[names.setdefault(f, len(names)) for f in telling_features(w)] for w in vocabulary], dtype=np.int64).reshape(-1, 4)
        pair = np.unique(self.doc * max(1, len(vocabulary)) + self.word)
        held = np.stack([np.repeat(pair // max(1, len(vocabulary)), 4), self.signs[pair % max(1, len(vocabulary))].ravel()], 1)
        # Every (document, feature) once.
        self.held = np.unique(held, axis=0)
        self.n_signs = len(names)

    def labels(self, toxic: np.ndarray, own: np.ndarray) -> np.ndarray:
        """0/1 per token from the labels of the documents in ``own``.

        A feature speaks for toxicity if more toxic documents hold it than chance explains (likelihood ratio at
        least ``RATIO_TEST``) and its smoothed rate there is ``RATE`` times that in clean ones; a token is toxic in
        a toxic document if its word or a prefix of four or more letters does.
        """
        docs, signs = self.held[own[self.held[:, 0]]].T
        n_toxic, n_clean = int((toxic & own).sum()), int((~toxic & own).sum())
        a = np.bincount(signs[toxic[docs]], minlength=self.n_signs).astype(float)
        b = np.bincount(signs[~toxic[docs]], minlength=self.n_signs).astype(float)
        expected = np.maximum((a + b) * n_toxic / (n_toxic + n_clean), 1e-9), np.maximum((a + b) * n_clean / (n_toxic + n_clean), 1e-9)
        ratio = 2 * sum(np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / e), 0.0) for x, e in zip((a, b), expected))
        telling = (ratio >= RATIO_TEST) & (a * n_clean >= RATE * (b + 0.1) * n_toxic)
        return telling[self.signs].any(1)[self.word] & toxic[self.doc]


def telling_features(word: str) -> list[str]:
    return ["w=" + word, "4=" + word[:4], "5=" + word[:5], "6=" + word[:6]]


def fit(texts: list[str], toxic: np.ndarray, odds: float = 1.0) -> Field:
    """A field from all texts, its curve from evidence of fields that did not see the text; ``odds`` are the labels' toxic : clean.

    A text the field was fitted to scores surer than a new one, so the texts are dealt into ``FOLDS`` parts, and each part is
    tagged by a field of the others.
    """
    field = Field()
    toxic = toxic.astype(bool)
    if not toxic.any() or toxic.all():
        field.offset = -2.0 if not toxic.any() else 2.0
        return field
    tokens = Tokens(texts)
    part = np.zeros(len(texts), np.int64)
    for label in (True, False):
        at = np.flatnonzero(toxic == label)
        part[at] = np.arange(len(at)) % FOLDS
    evidence = np.zeros((len(texts), 2))
    for k in range(FOLDS):
        own = part != k
        if not (own & toxic).any() or not (own & ~toxic).any():
            own = np.ones(len(texts), bool)
        fit_weights(field, tokens, toxic, own)
        left = np.flatnonzero(part == k)
        evidence[left] = field.evidence(field.tag([texts[i] for i in left]))
    fit_weights(field, tokens, toxic, np.ones(len(texts), bool))
    fit_curve(field, evidence, toxic, odds)
    return field


def fit_weights(field: Field, tokens: Tokens, toxic: np.ndarray, own: np.ndarray) -> None:
    """Penalised maximum likelihood over the documents in ``own`` by Rprop steps; the gradient is model expectation less observation."""
    inside = own[tokens.doc]
    y, word, lengths = tokens.labels(toxic, own)[inside], tokens.word[inside], tokens.lengths[own]
    grid = tokens.grid
    n_words, width = grid.shape
    size = len(tokens.slots) + 6  # bias, start, four transitions
    theta = np.zeros(size)
    theta[-6] = -3.0
    step, last = np.full(size, 0.3), np.zeros(size)
    heads = np.cumsum(lengths[lengths > 0]) - lengths[lengths > 0]
    inner = np.ones(len(word), bool)
    inner[heads] = False
    pairs = np.flatnonzero(inner)
    seen = np.bincount(word[y], minlength=n_words)
    observed_pairs = np.bincount(2 * y[pairs - 1] + y[pairs], minlength=4)
    for _ in range(ROUNDS if len(word) else 0):
        unary = (theta[grid].sum(1) + theta[-6])[word]
        transition = theta[-4:].reshape(2, 2)
        forward, backward, p = _recursions(unary, lengths, transition, theta[-5])
        # Pair posteriors from the forward odds before and the backward odds after.
        g = np.exp(np.clip(unary, -LIMIT, LIMIT))[pairs] * backward[pairs]
        f = forward[pairs - 1]
        e = np.exp(transition.reshape(4))
        cells = np.stack([np.full(len(pairs), e[0]), e[1] * g, e[2] * f, e[3] * f * g])
        cells /= cells.sum(0)
        by_word = np.bincount(word, weights=p, minlength=n_words) - seen
        gradient = np.zeros(size)
        gradient[:-6] = np.bincount(grid.ravel(), weights=np.repeat(by_word, width), minlength=len(tokens.slots))
        gradient[-6] = by_word.sum()
        gradient[-5] = (p[heads] - y[heads]).sum()
        gradient[-4:] = cells.sum(1) - observed_pairs
        gradient += PENALTY * len(lengths) * theta * 0.1
        agree = gradient * last
        step = np.clip(np.where(agree > 0, step * 1.3, np.where(agree < 0, step * 0.5, step)), 1e-4, 1.0)
        theta -= np.sign(gradient) * step
        theta[-4:] = np.clip(theta[-4:], -4, 4)
        last = np.where(agree < 0, 0.0, gradient)
    names = list(tokens.slots)
    field.weights = {names[i]: float(theta[i]) for i in np.flatnonzero(np.abs(theta[:-6]) > 1e-6)}
    field.bias, field.start, field.transition = float(theta[-6]), float(theta[-5]), theta[-4:].reshape(2, 2).copy()
    field.known = {}


def fit_curve(field: Field, evidence: np.ndarray, toxic: np.ndarray, odds: float) -> None:
    """Logistic curve from the evidence to the document's label for labels of these odds.

    More evidence never lowers a score: a slope that would fall below zero is held at zero and the others, the intercept
    included, are fitted anew. Evidence that is the same for all texts leaves the labels' odds.
    """
    spread = evidence.std(0)
    middle = evidence.mean(0)
    free = [j for j in range(evidence.shape[1]) if spread[j] > 1e-9]
    while True:
        design = np.column_stack([*[(evidence[:, j] - middle[j]) / spread[j] for j in free], np.ones(len(evidence))])
        penalty = np.diag([0.3] * len(free) + [1e-6])
        beta = np.zeros(len(free) + 1)
        beta[-1] = np.log(toxic.sum() / (~toxic).sum())
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            change = np.linalg.solve(design.T @ (design * (q * (1 - q))[:, None]) + penalty, design.T @ (q - toxic) + penalty @ beta)
            beta -= np.clip(change, -2, 2)
        negative = [j for j, v in zip(free, beta[:-1]) if v < 0]
        if not negative:
            break
        free = [j for j in free if j not in negative]
    field.slopes = np.zeros(evidence.shape[1])
    for j, v in zip(free, beta[:-1]):
        field.slopes[j] = v / spread[j]
    sampled = toxic.sum() / (~toxic).sum()
    field.offset = float(beta[-1] - field.slopes @ middle + np.log(odds / sampled))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, parts: int, held: int, rows: int, chars: int) -> tuple[list[tuple[str, int]], float]:
    """At most ``rows`` labelled texts per class and ``chars`` characters in all, by hash of the id, from the learning folds.

    Ids and lengths are ordered, the chosen texts are then read; a text longer than what is left is passed over.
    With it come the odds of the labels in the learning folds.
    """
    marks = labels.select(F.col("doc_id").cast("string").alias("l_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    pool = docs.where(fold("doc_id", parts) != held).select("doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("key")).join(marks, F.col("doc_id") == F.col("l_id"))
    chosen: dict = {}
    for label in (1, 0):
        left = chars // 2
        for r in pool.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id", "n", "key").limit(rows).collect():
            if r["n"] <= left and r["doc_id"] not in chosen:
                left -= r["n"]
                chosen[r["doc_id"]] = label, r["key"]
    if not chosen:
        return [], 1.0
    counts = {r["label"]: r["count"] for r in pool.groupBy("label").count().collect()}
    wanted = docs.sparkSession.createDataFrame([(i, key) for i, (_, key) in chosen.items()], "w_id string, w_key long")
    # Of rows that repeat an id only the chosen text is fetched, and once.
    same = (F.col("doc_id") == F.col("w_id")) & (F.xxhash64("text") == F.col("w_key"))
    found = docs.join(F.broadcast(wanted), same, "left_semi").dropDuplicates(["doc_id"]).collect()
    texts = {r["doc_id"]: r["text"] for r in found}
    return [(texts[i], chosen[i][0]) for i in sorted(texts)], max(counts.get(1, 0), 1) / max(counts.get(0, 0), 1)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    parts: int = 3, held: int = 1, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_toxic (expected toxic tokens), spans.

    ``spans`` are (start, end, probability) in characters of the text, one for each run of tokens
    whose marginal is at least one half. A null text counts as empty; a text without words
    scores as one without evidence. Without labels of both classes no token is
    toxic. Labels outside the learning folds are never read; repeated rows score alike.
    """
    rows_in, kind = keyed(docs, id_col, text_col)
    learned, odds = sample(rows_in, labels, label_col, parts, held, rows, chars)
    field = fit([t for t, _ in learned], np.array([y for _, y in learned], dtype=bool), odds)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def spans(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
        if not len(p) or p.max() < SPAN:
            return []
        out: list[list] = []
        for i, m in enumerate(_spans(lowered(text))):
            if p[i] >= SPAN:
                if out and out[-1][3] == i - 1:
                    out[-1][1:] = [m.end(), max(out[-1][2], float(p[i])), i]
                else:
                    out.append([m.start(), m.end(), float(p[i]), i])
        return [(a, b, c) for a, b, c, _ in out]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for frame in frames:
            sizes = frame["text"].str.len().to_numpy().cumsum() // BATCH_CHARS if len(frame) else []
            for _, piece in frame.groupby(sizes, sort=True):
                texts = piece["text"].tolist()
                tagged = model.tag(texts)
                score = model.score(model.evidence(tagged))
                yield pd.DataFrame({
                    "doc_id": piece["doc_id"], "score": score, "n_toxic": [float(p.sum()) for p in tagged],
                    "spans": [spans(t, p) for t, p in zip(texts, tagged, strict=True)],
                })

    schema = "doc_id string, score double, n_toxic double, spans array<struct<start:int,end:int,probability:double>>"
    return unkeyed(rows_in.mapInPandas(batches, schema), kind).select(
        "doc_id", (fold("doc_id", parts) == held).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), F.round("n_toxic", 6).alias("n_toxic"), "spans",
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
