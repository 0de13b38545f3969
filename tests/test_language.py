"""The learned language rule: held-out accuracy, odd texts, ties."""

import math

import pytest
from pyspark.sql import functions as F

from citegraph.operators import language
from citegraph.plans.queries import QUERIES


def test_held_out_accuracy(spark):
    rows = QUERIES["language_verdicts"](spark, "/root/testdata/sf0.001").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 20
    assert sum(r["lang"] == r["detected"] for r in rows) >= 0.9 * len(rows)


@pytest.fixture(scope="module")
def profiles(spark):
    known = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "fr"), ("12 34", "es"), ("x y z", None)],
                                  "text string, lang string")
    return language.learn_profiles(known).cache()


def test_profiles_are_smoothed_distributions(profiles):
    by_lang = {}
    for r in profiles.collect():
        by_lang.setdefault(r["lang"], []).append(math.exp(r["logp"]))
    # Languages without a single trigram have no profile.
    assert set(by_lang) == {"en", "de"}
    assert all(sum(p) == pytest.approx(1.0) and min(p) > 0 for p in by_lang.values())


def test_verdicts_of_odd_texts(spark, profiles):
    texts = [(1, "The DOG and the cat!"), (2, "die Katze"), (3, None), (4, ""), (5, "1 2 3"), (6, "qqq"), (7, "und " * 50_000), (8, "der, der\nHund")]
    found = dict(map(tuple, language.judge(spark.createDataFrame(texts, "id long, text string"), profiles, "id").collect()))
    assert found == {1: "en", 2: "de", 7: "de", 8: "de"}
    assert language.judge(spark.createDataFrame(texts, "id long, text string").limit(0), profiles, "id").count() == 0
    # Equal profiles leave the first name.
    same = profiles.where("lang = 'en'").withColumn("lang", F.explode(F.array(F.lit("b"), F.lit("a"))))
    assert language.judge(spark.createDataFrame([(1, "the")], "id long, text string"), same, "id").first()["detected"] == "a"


def test_tasks_send_counts_and_not_occurrences(spark):
    texts = [("en", " the the "), ("en", " the "), ("de", " \U0001d504b "), ("de", None), ("en", "  ")]
    rows = language.count_trigrams(spark.createDataFrame(texts * 2000, "lang string, text string").coalesce(1)).collect()
    # One row per language and trigram, characters beyond 16 bits whole.
    assert {(r["lang"], r["gram"]): r["n"] for r in rows} == {
        ("en", " th"): 6000, ("en", "the"): 6000, ("en", "he "): 6000, ("en", "e t"): 2000, ("de", " \U0001d504b"): 2000, ("de", "\U0001d504b "): 2000}
    assert len(rows) == 6
