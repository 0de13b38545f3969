"""Array expressions: intents, author lists, name lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bit of every intent label and the display name of every combination.
INTENT_BITS = {"background": 1, "methodology": 2, "result": 4}
INTENT_NAMES = {
    0: "no label", 1: "background", 2: "methodology", 3: "background + methodology", 4: "result",
    5: "background + result", 6: "methodology + result", 7: "background + methodology + result",
}


def or_empty(column: Column) -> Column:
    """NULL list to the empty string list."""
    return F.coalesce(column, F.array().cast("array<string>"))


def flat_intents(intents: Column) -> Column:
    """One label list in first-occurrence order, without NULL and empty labels.

    NULL inner lists go first, because ``flatten`` answers NULL when it meets one.
    """
    lists = F.coalesce(intents, F.array().cast("array<array<string>>"))
    labels = F.flatten(F.filter(lists, lambda part: part.isNotNull()))
    return F.array_distinct(F.filter(labels, lambda x: x.isNotNull() & (x != "")))


def background_only(intents: Column) -> Column:
    """the edge carries labels and every one of them is ``background``."""
    return flat_intents(intents) == F.array(F.lit("background"))


def shares_member(left: Column, right: Column) -> Column:
    """two-valued list overlap; NULL lists and NULL members never match."""
    return F.coalesce(F.arrays_overlap(left, right), F.lit(False))


def intent_code(labels: Column) -> Column:
    """Bitmask over a flat label list; unknown labels count nothing."""
    bits = F.create_map(*[F.lit(x) for pair in INTENT_BITS.items() for x in pair])
    return F.aggregate(labels, F.lit(0), lambda acc, x: acc + F.coalesce(bits[x], F.lit(0)))


def intent_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in INTENT_NAMES.items() for x in pair])
    return names[code]


def intent_key(labels: Column) -> Column:
    """Sorted labels joined by '/', ``unknown`` when there are none."""
    return F.coalesce(F.nullif(F.array_join(F.array_sort(labels), "/"), F.lit("")), F.lit("unknown"))


def non_empty(column: Column) -> Column:
    """Empty text to NULL."""
    return F.nullif(column, F.lit(""))


def null_if_empty_list(column: Column) -> Column:
    return F.when(F.size(column) > 0, column)
