"""Deterministic stand-ins for model back ends."""

import hashlib
import math

import numpy as np


class HashedBag:
    """Bag-of-words encoder: hashed word counts, unit length."""

    def __init__(self, width=64):
        self.width = width

    def encode(self, texts):
        rows = np.zeros((len(texts), self.width), dtype=np.float32)
        for row, text in zip(rows, texts):
            for word in text.lower().split():
                row[int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "big") % self.width] += 1
        lengths = np.linalg.norm(rows, axis=1, keepdims=True)
        return rows / np.where(lengths > 0, lengths, 1)


class WordOverlap:
    """Reranker: logistic of the word-set overlap."""

    def score(self, queries, documents):
        scores = []
        for query, document in zip(queries, documents):
            a, b = set(query.lower().split()), set(document.lower().split())
            scores.append(1 / (1 + math.exp(-12 * (len(a & b) / max(len(a | b), 1) - 0.3))))
        return scores


class KeywordRoles:
    """Labeller: a few cue words per role, BACKGROUND otherwise."""

    CUES = (("RESULT", ("outperform", "results show", "achiev")), ("OTHER", ("available at", "github")),
            ("OBJECTIVE", ("we propose", "this paper")), ("METHOD", ("using", "train")))

    def reply(self, prompts):
        return ["\n".join(self._lines(p)) for p in prompts]

    def _lines(self, prompt):
        for line in prompt.split("\n"):
            number, mark, sentence = line.partition(": ")
            if mark and number.isdigit():
                role = next((r for r, cues in self.CUES if any(c in sentence.lower() for c in cues)), "BACKGROUND")
                yield f"{number}: {role}"
