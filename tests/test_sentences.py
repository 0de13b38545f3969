"""Sentences by corpus statistics: abbreviations, starters, collocations and the cuts they lead to."""

import pytest
from pyspark.sql import functions as F

from citegraph.operators import models, removal, sentences as S

NOUNS = ["cats", "dogs", "rivers", "stones", "clouds", "fields", "roads", "trees", "birds", "ships"]
COMMON = [f"The {a} met some {b} near old {c}. It was late in the end. It was late." for a in NOUNS for b in NOUNS for c in NOUNS[:3]]


@pytest.fixture(scope="module")
def corpus(spark):
    odd = [
        "We saw ca. Twenty ships. The end", "They cost ca. Ninety coins. It was late!", "About ca. Forty roads ran (north). 'The rest' did not.",
        "Was it ca. Fifty? It was.", "By J. Miller and others. the rest", None, "", "  \n ", "one",
    ]
    rows = [(i, t) for i, t in enumerate(odd + ["He left ca. Sixty stones. The end of late roads."] * 30 + COMMON)]
    return spark.createDataFrame(rows, "id int, text string")


def test_abbreviations_and_starters(corpus):
    pairs = S.word_pairs(corpus).cache()
    abbrevs = S.abbreviations(pairs)
    known = {r.word: (r.n_stop, r.n_plain) for r in abbrevs.where(F.col("score") >= S.ABBREVIATION_FROM).collect()}
    assert known == {"ca": (34, 0), "j": (1, 0)}
    starting = {r.word for r in S.starters(pairs, abbrevs).where(F.col("ratio") >= S.STARTER_FROM).collect()}
    assert "it" in starting and "sixty" not in starting
    tied = {(r.first, r.second): r.n for r in S.collocations(pairs, abbrevs).collect()}
    assert tied == {("ca", "sixty"): 30}


def test_counts_grow_with_the_vocabulary(spark, corpus):
    """Plain words stand alone; the sums over firsts and seconds are those of all neighbours."""
    texts = spark.createDataFrame([(" ".join(f"{a} {b}" for a in "abcdefghijkl" for b in "abcdefghijkl"),), ("End. Abc d!\u2028 (\"x.,\" 3.5, Y",)], "text string")
    pairs = S.word_pairs(texts)
    assert pairs.where("NOT stop AND mark IS NULL AND first IS NOT NULL AND second IS NOT NULL AND n > 0").where("first RLIKE '^[a-z]$'").count() == 0
    assert pairs.count() < 40
    rows = texts.unionByName(corpus.select("text")).select(F.filter(F.split("text", S.SPACE), lambda w: w != "").alias("w"))
    words = rows.select(F.posexplode("w").alias("i", "word")).select("i", S.core(F.col("word")).alias("c"))
    firsts = {r.c: r["count"] for r in words.groupBy("c").count().collect()}
    seconds = {r.c: r["count"] for r in words.where("i > 0").groupBy("c").count().collect()}
    pairs = S.word_pairs(texts.unionByName(corpus.select("text")))
    summed = lambda name: {r[0]: r.n for r in pairs.where(F.col(name).isNotNull()).groupBy(name).agg(F.sum("n").alias("n")).collect()}
    assert summed("first") == firsts and summed("second") == seconds


def test_cuts(corpus):
    out = {r.id: r.sentences for r in S.learned_sentences(corpus, ["id"]).where("id < 10").collect()}
    assert out[0] == ["We saw ca. Twenty ships.", "The end"]
    assert out[2] == ["About ca. Forty roads ran (north).", "'The rest' did not."]
    assert out[3] == ["Was it ca. Fifty?", "It was."]
    assert out[4] == ["By J. Miller and others. the rest"]
    assert out[5] == out[6] == out[7] == [] and out[8] == ["one"]


def test_empty_table_and_clashing_names(spark, corpus):
    assert S.learned_sentences(corpus.limit(0), ["id"]).count() == 0
    out = S.learned_sentences(corpus.where("id < 3").select("id", "text", F.lit(1).alias("first"), F.lit(2).alias("at")), ["id"])
    assert {"first", "at", "sentences"} <= set(out.columns) and out.count() == 3


def test_sentences_reach_labels_and_removal(spark, corpus):
    class Ends:
        def reply(self, prompts):
            return ["0: RESULT\n1: METHOD"] * len(prompts)

    units = S.learned_sentences(corpus, ["id"]).where("id in (0, 3)")
    labels = models.label_texts(units, Ends, ["id"], None)
    kept = {r.id: r.kept for r in removal.strip_units(units, labels, ["id"], None).collect()}
    assert kept == {0: "The end", 3: "It was."}


def test_texts_do_not_meet_the_table(corpus):
    """Only the places in question are joined with the learned pairs."""
    kept = S.joined_pairs(S.word_pairs(corpus))
    plan = S.split(corpus, ["id"], kept)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Cross" not in plan.split("LeftAnti")[0]


def test_units_with_labels_need_no_join(spark):
    units = spark.createDataFrame([(1, "A. B.", ["A.", "B."], ["RESULT", None]), (2, "", [], [])], "id int, text string, sentences array<string>, labels array<string>")
    apart = removal.strip_units(units.drop("labels"), units.select("id", "labels"), ["id"], None)
    out = removal.strip_units(units, None, ["id"], None)
    assert sorted(out.collect()) == sorted(apart.select(out.columns).collect())
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
