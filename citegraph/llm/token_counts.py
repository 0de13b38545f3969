"""Token counts under a unigram vocabulary: Viterbi that carries score and piece count, never the pieces.

Rules of the tokenizer, kept exactly: spaces become U+2581 and a non-empty text gets one in front; the best path maximises the
sum of piece scores in double precision; an end position takes the first candidate of the best score in ascending order of
starts, so of equal paths the longer last piece wins; a character that no one-character piece covers can be an unknown
piece of the lowest score less 10; with byte fallback an unknown character counts one piece per UTF-8 byte, without it each
run of unknown characters counts one.

No piece has U+2581 after another character, so paths of the stretches between such places are independent and a
stretch's result is kept for its next occurrence. Aho-Corasick enumerates the matches of a stretch that is new.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import keyed, table, unkeyed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
# Stretches kept per Python worker; when full the store starts anew, which changes speed only.
KEPT = 600_000


def read_pieces(path: str = MODEL) -> tuple[dict[str, float], float, bool]:
    """Matchable pieces with scores, the lowest score of all pieces, and whether bytes are pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return (
        {model.id_to_piece(i): model.get_score(i) for i in plain}, min(model.get_score(i) for i in ids),
        any(model.is_byte(i) for i in ids),
    )


class Counter(dict):
    """Piece counts by stretch of text, computed when first asked for; one per Python worker."""

    def __init__(self, pieces: dict[str, float], lowest: float, byte_fallback: bool):
        import ahocorasick

        super().__init__()
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = lowest - UNKNOWN_PENALTY
        self.bytes = byte_fallback
        whole = byte_fallback and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        # Without byte fallback a run of unknown characters may span stretches; such a text is one stretch.
        self.stretches = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if whole else r"(?s).+").findall

    def __missing__(self, stretch: str) -> int:
        n = self.covered(stretch) if self.single.issuperset(stretch) else self.uncovered(stretch)
        if len(stretch) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[stretch] = n
        return n

    def covered(self, text: str) -> int:
        """Pieces of the best path; every character is a piece itself, so no unknown piece can take part.

        Matches come by ascending end and, for one end, longest first, that is by ascending start.
        """
        score, count = [0.0] + [float("-inf")] * len(text), [0] * (len(text) + 1)
        for end, (length, value) in self.machine.iter(text):
            end += 1
            start = end - length
            value += score[start]
            if value > score[end]:
                score[end] = value
                count[end] = count[start] + 1
        return count[-1]

    def uncovered(self, text: str) -> int:
        """The same with unknown pieces of one character wherever no one-character piece matches."""
        n = len(text)
        score, count, ends_unknown = [0.0] + [float("-inf")] * n, [0] * (n + 1), [False] * (n + 1)
        matches = self.machine.iter(text)
        end, piece = next(matches, (n, None))
        for e in range(n):
            while end == e:
                start, value = e + 1 - piece[0], piece[1]
                value += score[start]
                if value > score[e + 1]:
                    score[e + 1], count[e + 1] = value, count[start] + 1
                end, piece = next(matches, (n, None))
            value = self.unknown + score[e]
            if text[e] not in self.single and value > score[e + 1]:
                score[e + 1], ends_unknown[e + 1] = value, True
                count[e + 1] = count[e] + (len(text[e].encode("utf-8", "surrogatepass")) if self.bytes else not ends_unknown[e])
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.stretches(SPACE + text.replace(" ", SPACE))))


_counters: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per input row: doc_id, n_tokens.

    A null text counts as empty and has no tokens; repeated rows are counted each. ``model`` is read on the driver; the pieces,
    as many as the vocabulary has, go to the workers.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_pieces(model))
    key = hash((spark.sparkContext.applicationId, model))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _counters:
            _counters[key] = Counter(*shared.value)
        counter = _counters[key]
        for frame in frames:
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "n_tokens": pd.Series([counter.count(t) for t in frame["text"]], dtype="int64"),
            })

    rows, kind = keyed(docs, id_col, text_col)
    return unkeyed(rows.mapInPandas(batches, "doc_id string, n_tokens long"), kind)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
