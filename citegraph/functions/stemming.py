"""Porter stemming (Porter 1980), the word normalisation of the ROUGE-L score."""

from __future__ import annotations

from functools import lru_cache

# Suffix tables of the published algorithm.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """Consonant/vowel string: y is a vowel after a consonant."""
    marks = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and marks[-1] == "c")
        marks += "v" if vowel else "c"
    return marks


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, table, least: int) -> str:
    """Replace the longest matching suffix when the rest measures more than ``least``."""
    for old, new in sorted(table, key=lambda pair: -len(pair[0])):
        if word.endswith(old):
            stem = word[: -len(old)]
            return stem + new if _measure(stem) > least else word
    return word


@lru_cache(maxsize=65_536)
def porter(word: str) -> str:
    if len(word) <= 2:
        return word
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(old):
            word = word[: len(word) - len(old)] + new
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _doubled(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, STEP_2, 0)
    word = _swap(word, STEP_3, 0)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
