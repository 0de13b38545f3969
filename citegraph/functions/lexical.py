"""ROUGE-L of two texts, used inside Arrow functions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np


def rouge_tokens(text: str, stem: Callable[[str], str] | None = None) -> list[str]:
    words = re.findall(r"[a-z0-9]+", text.lower())
    return [stem(w) if stem and len(w) > 3 else w for w in words]


def positions(words: Sequence[str]) -> dict[str, int]:
    """Per token a number whose bit i is 1 where the token stands at place i."""
    where: dict[str, int] = {}
    for i, word in enumerate(words):
        where[word] = where.get(word, 0) | (1 << i)
    return where


def subsequence_with(where: dict[str, int], length: int, b: Sequence[str]) -> int:
    """Length of the longest common subsequence of the text behind ``where`` and ``b``, one word-parallel row per token.

    Bit i of ``row`` is 0 where the subsequence length grows at place i.
    """
    full = (1 << length) - 1
    row = full
    for word in b:
        hits = row & where.get(word, 0)
        if hits:
            row = ((row + hits) | (row - hits)) & full
    return length - row.bit_count()


def common_subsequence(a: Sequence[str], b: Sequence[str]) -> int:
    return subsequence_with(positions(a), len(a), b)


def f1(shared: int, n_target: int, n_prediction: int) -> float:
    if not shared:
        return 0.0
    precision, recall = shared / n_prediction, shared / n_target
    return 2 * precision * recall / (precision + recall)


def rouge_l_f1(target: Sequence[str], prediction: Sequence[str]) -> float:
    return f1(common_subsequence(target, prediction), len(target), len(prediction))


class PredictionIndex:
    """Inverted index over a block of predictions: which of them hold a token, and how often.

    Tokens that two texts share as multisets bound their common subsequence from above. The
    predictions are therefore scored from the highest bound down, and the rest is left out as
    soon as no bound exceeds the best score found. ``scored`` counts the subsequences computed.
    """

    def __init__(self, predictions: Sequence[Sequence[str]]):
        self.predictions = predictions
        self.lengths = np.array([len(p) for p in predictions], np.int64)
        self.scored = 0
        held: dict[str, tuple[list[int], list[int]]] = {}
        for i, words in enumerate(predictions):
            for word, count in Counter(words).items():
                at, counts = held.setdefault(word, ([], []))
                at.append(i)
                counts.append(count)
        self.held = {word: (np.array(at), np.array(counts)) for word, (at, counts) in held.items()}

    def best(self, target: Sequence[str]) -> float:
        """Highest F1 of the target against the block's predictions."""
        overlap = np.zeros(len(self.predictions), np.int64)
        for word, count in Counter(target).items():
            if word in self.held:
                at, counts = self.held[word]
                overlap[at] += np.minimum(counts, count)
        # F1 is 2 s / (m + n) for a shared length s; the small surplus covers rounding of the exact score.
        bound = 2.0 * overlap / np.maximum(self.lengths + len(target), 1) * (1 + 1e-12)
        where, top = positions(target), 0.0
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] <= top:
                break
            self.scored += 1
            shared = subsequence_with(where, len(target), self.predictions[i])
            top = max(top, f1(shared, len(target), int(self.lengths[i])))
        return top


def matched_orders(texts: Sequence[Sequence[str]], ids: Sequence) -> list[list[int]]:
    """Per text of a set its length, the closest length of another one and its 1- to 4-grams also found in one of the others.

    An n-gram counts as often as in one other text at most. Texts of one id are one text to the others; a null id matches nothing.
    """
    same = Counter(map(len, texts))
    ordered = sorted(same)
    beside = {}
    for i, n in enumerate(ordered):
        around = [n] if same[n] > 1 else ordered[max(i - 1, 0):i] + ordered[i + 1:i + 2]
        beside[n] = min(around, key=lambda x: (abs(x - n), x), default=None)
    hits = {one: [0] * 4 for one in ids}
    for order in range(4):
        grams: dict = {}
        for one, words in zip(ids, texts):
            if one is not None:
                grams.setdefault(one, Counter()).update(zip(*[words[k:] for k in range(order + 1)]))
        # The largest count with its holder, and the largest of all other texts.
        top: dict = {}
        second: dict = {}
        for one, found in grams.items():
            for gram, c in found.items():
                held = top.get(gram)
                if held is None:
                    top[gram] = c, one
                elif c > held[0]:
                    second[gram], top[gram] = held[0], (c, one)
                elif c > second.get(gram, 0):
                    second[gram] = c
        for gram, other in second.items():
            hits[top[gram][1]][order] += other
        for one, found in grams.items():
            hits[one][order] += sum(found[gram] for gram in found.keys() & second.keys() if top[gram][1] != one)
    return [[len(words), beside[len(words)], *hits[one]] for one, words in zip(ids, texts)]
