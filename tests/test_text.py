"""Text expressions, lexical scores and result removal."""

import math

import pytest
from pyspark.sql import functions as F

from citegraph.functions import arrays, hashing, lexical as L, strata as S, text as TX
from citegraph.functions.stemming import porter
from citegraph.operators import lexical, removal
from citegraph.plans import strip
from citegraph.sources import results


def apply(spark, expression, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize("reply, answer", [
    ("Nothing leaked here.", "Nothing leaked here."),
    ("analysis first I weigh both sides\nassistantfinal\n Both matter.", "Both matter."),
    ("one assistantfinal two assistantfinal three", "two assistantfinal three"),
    ("\n analysis that was cut off", ""),
    ("<think>\nsteps\n</think>\n\nDone.", "Done."),
    ("Start <think>p</think> middle <think>q</think> end", "Start middle end"),
    ("Fine <think>but unfinished", ""),
    ("<|channel>thought a<channel|>b<channel|>  final words", "final words"),
    ("<|channel>thought without an end", ""),
    ("", ""),
])
def test_reasoning_is_removed(spark, reply, answer):
    assert apply(spark, TX.strip_reasoning, [reply]) == [answer]


@pytest.mark.parametrize("raw, clean", [
    ("TITLE: Sorting apples\n\nWe sort apples.", "We sort apples."),
    ("**A heading of its own**\n\nWe sort **red** apples.", "We sort red apples."),
    ("Proposal:  We sort apples.", "We sort apples."),
    ("**Abstract** - We sort apples.", "We sort apples."),
    ("ABSTRACT\nWe sort apples.", "We sort apples."),
    ("Proposals for sorting apples abound.", "Proposals for sorting apples abound."),
    ('\u00a0"We sort apples." \n', "We sort apples."),
    ("**Abstract:**", ""),
])
def test_output_is_cleaned(spark, raw, clean):
    assert apply(spark, TX.clean_output, [raw]) == [clean]


@pytest.mark.parametrize("reply, abstracts", [
    ('Here you go: [{"abstract": "Red", "probability": 0.3}, {"abstract": "  Green\\n"}] - enjoy', ["Red", "Green"]),
    ("I have nothing to list.", []),
    ('{"abstract": "Braces } and { inside", "n": {"deep": 1}} and then {"abstract": "Blue"} {"abstract": "cut', ["Braces } and { inside", "Blue"]),
    ('[{"abstract": null}, 7, {"abstract": "   "}, {"other": "x"}]', []),
    ('He said "hi" {"abstract": "After a quote"}', ["After a quote"]),
    ('[1] is broken {"abstract": "A \\"quoted\\" word"}', []),
])
def test_lists_are_parsed(spark, reply, abstracts):
    assert apply(spark, TX.parse_list, [reply]) == [abstracts]


def test_extraction_by_kind(spark):
    assert apply(spark, lambda c: TX.extract(c, "independent"), ["<think>x</think>Abstract: Pears.", "**Abstract:**"]) == [["Pears."], []]
    both = '[{"abstract": "Abstract: Pears."}, {"abstract": "**Abstract:**"}, {"abstract": "Plums."}]'
    assert apply(spark, lambda c: TX.extract(c, "verbalized"), [both]) == [["Pears.", "Plums."]]


def test_labels(spark):
    reply = "0: BACKGROUND\n[1]. method\n 2 - **RESULT**\n1: OTHER\n3: NONSENSE\n5: RESULT"
    assert apply(spark, lambda c: TX.parse_labels(c, F.lit(5)), [reply]) == [["BACKGROUND", "OTHER", "RESULT", None, None]]
    assert apply(spark, lambda c: TX.parse_labels(c, F.lit(0)), [reply]) == [[]]


def test_sentences_and_words(spark):
    text = "  First one.  It has\n3.5 points! \"Quoted?\" Yes. e.g. this stays. "
    assert apply(spark, TX.split_sentences, [text, "", "no end"]) == [
        ["First one.", "It has 3.5 points!", '"Quoted?" Yes. e.g. this stays.'], [], ["no end"]]
    guarded = "We follow Smith et al. 2020 here. See Fig. 3 and Dr. Who vs. BERT. J. R. Roe agrees."
    assert apply(spark, TX.split_sentences, [guarded]) == [
        ["We follow Smith et al. 2020 here.", "See Fig. 3 and Dr. Who vs. BERT.", "J. R. Roe agrees."]]
    assert apply(spark, TX.segmenter(lambda t: t.split(";")), ["a; b ;;c"]) == [["a", "b", "c"]]
    assert apply(spark, TX.word_count, ["a  b\tc d", " "]) == [4, 0]
    assert apply(spark, TX.tokens, ["The  Cat"]) == [["the", "cat"]]


def test_hashes(spark):
    from hashlib import blake2b
    ids = list(range(50))
    found = apply(spark, lambda c: hashing.stable_hash("seed", c), ids, "int")
    assert found == [blake2b(f"seed\t{i}".encode(), digest_size=8).hexdigest() for i in ids]
    order = sorted(ids, key=lambda i: int.from_bytes(blake2b(f"seed\t{i}".encode(), digest_size=8).digest(), "big"))
    assert sorted(ids, key=lambda i: found[i]) == order != ids
    assert apply(spark, hashing.text_key, ["é"]) == [blake2b("é".encode(), digest_size=12).hexdigest()]


def test_intents(spark):
    cases = [[["background"], ["methodology", "background"], None], None, [], [None], [["background", None, ""]], [["x"]]]
    kind = "array<array<string>>"
    assert apply(spark, arrays.flat_intents, cases, kind) == [["background", "methodology"], [], [], [], ["background"], ["x"]]
    assert apply(spark, arrays.background_only, cases, kind) == [False, False, False, False, True, False]
    flat = [["background", "result"], [], ["methodology"], ["x", "result"]]
    assert apply(spark, arrays.intent_code, flat, "array<string>") == [5, 0, 2, 4]
    assert apply(spark, arrays.intent_key, [["b", "a"], []], "array<string>") == ["a/b", "unknown"]


def test_author_overlap(spark):
    rows = [(["a", None], ["b"]), (["a"], ["a", "b"]), (None, ["a"]), ([], ["a"]), (["a"], None)]
    df = spark.createDataFrame(rows, "l array<string>, r array<string>")
    assert [r.x for r in df.select(arrays.shares_member(F.col("l"), F.col("r")).alias("x")).collect()] == [False, True, False, False, False]


def test_strata(spark):
    assert apply(spark, S.horizon_bucket, [-1, 0, 1, 2, 3, 4, 6, 7, 120], "int") == [
        "neg", "0-1y", "0-1y", "2-3y", "2-3y", "4-6y", "4-6y", "7y+", "7y+"]
    assert apply(spark, S.year_label, [2014, 2015, None, 0], "int") == ["<=2014", "2015", None, None]
    rows = [("2025-02-01", 2020), ("2025-01-31", 2026), (None, 2024), (None, 2025), ("", 2024), (None, None)]
    df = spark.createDataFrame(rows, "d string, y int")
    assert [r.s for r in df.select(S.cutoff_stratum(F.col("d"), F.col("y")).alias("s")).collect()] == [
        "post", "pre", "pre", None, "pre", None]
    assert S.log_bin_labels()[:4] == ["1", "2", "3-4", "5-9"] and S.log_bin_labels()[-1] == "10,000+"
    assert apply(spark, S.log_bin, [0, 1, 4, 10**9, 10**9 + 1], "long") == [None, 0, 2, 15, None]


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_lexical_helpers():
    import random
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert L.common_subsequence(a, b) == lcs(a, b)
    assert L.rouge_l_f1(list("abc"), list("axc")) == pytest.approx(2 / 3)
    assert [porter(w) for w in ("relational", "hopping", "controlling", "happy")] == ["relat", "hop", "control", "happi"]


def test_lexical_operators(spark):
    same, diff = ["the cat sat on the mat"] * 4, ["the cat sat on the mat", "a dog ran in the park", "quantum chips beat noise", "rivers carve deep canyons"]
    rows = [("same", i, t) for i, t in enumerate(same)] + [("diff", i, t) for i, t in enumerate(diff)] + [("short", 0, "word")]
    df = spark.createDataFrame(rows, "g string, i int, text string")
    distinct = {r.g: r.distinct2 for r in lexical.distinct_n(df, ["g"]).collect()}
    assert distinct["same"] == pytest.approx(5 / 20) and distinct["diff"] == 1.0 and math.isnan(distinct["short"])
    bleu = {r.g: r.self_bleu for r in lexical.self_bleu(df, ["g"], "i").collect()}
    assert bleu["same"] == pytest.approx(100) and bleu["diff"] < 20 and math.isnan(bleu["short"])
    refs = spark.createDataFrame([("diff", "a dog ran in a park"), ("diff", "zzz")], "g string, text string")
    row = lexical.rouge_l_max(df, refs, ["g"], "i").first()
    assert row.rouge_l == pytest.approx((5 / 6 + 0) / 2)
    assert {r.g: r.mean_len for r in lexical.mean_length(df, ["g"]).collect()}["same"] == 6


def plain_bleu(texts):
    """Mean leave-one-out BLEU from whole count tables."""
    import collections
    grams = [[collections.Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) for n in range(1, 5)] for w in texts]
    scores = []
    for i, w in enumerate(texts):
        others = [j for j in range(len(texts)) if j != i]
        logs, halved, found = [], 0, 0
        for n in range(4):
            total = len(w) - n
            if total > 0:
                hits = sum(min(c, max(grams[j][n][g] for j in others)) for g, c in grams[i][n].items())
                halved += hits == 0
                found += hits
                logs.append(math.log(100 * hits / total if hits else 100 / (2**halved * total)))
        ref = min((len(texts[j]) for j in others), key=lambda x: (abs(x - len(w)), x))
        scores.append((1 if len(w) >= ref else math.exp(1 - ref / len(w))) * math.exp(sum(logs) / len(logs)) if found else 0)
    return sum(scores) / len(scores)


def test_self_bleu_of_large_and_small_sets_is_one(spark):
    import random
    rng = random.Random(5)
    sets = {g: [[rng.choice("red green blue, grey pink 1.5 teal.".split()) for _ in range(rng.randint(1, 9))] for _ in range(n)] for g, n in
            (("a", 1), ("b", 2), ("c", 40))}
    rows = [(g, i, " ".join(w)) for g, texts in sets.items() for i, w in enumerate(texts)]
    df = spark.createDataFrame(rows, "g string, i int, text string")
    # Every set where its texts meet, large ones n-gram by n-gram, and all of them so.
    results = [{r.g: r.self_bleu for r in lexical.self_bleu(df, ["g"], "i", whole=n).collect()} for n in (10**6, 200, 0)]
    assert results[0].keys() == sets.keys() and math.isnan(results[0]["a"])
    for other in results[1:]:
        assert all(other[g] == pytest.approx(results[0][g], nan_ok=True) for g in sets)
    assert L.matched_orders([["a", "b", "a"], ["a", "b"], ["c"]], [1, 2, None]) == [[3, 2, 2, 1, 0, 0], [2, 1, 2, 1, 0, 0], [1, 2, 0, 0, 0, 0]]


def test_every_text_of_a_large_set_counts(spark):
    import random
    rng = random.Random(3)
    texts = [[rng.choice("red green blue grey pink teal".split()) for _ in range(rng.randint(1, 12))] for _ in range(150)]
    df = spark.createDataFrame([("g", i, " ".join(w)) for i, w in enumerate(texts)] + [("g", 999, "  ")], "g string, i int, text string")
    assert lexical.self_bleu(df, ["g"], "i").first().self_bleu == pytest.approx(plain_bleu(texts))
    refs = [texts[3] + ["red"], ["none", "known"]]
    best = [max(2 * lcs(r, t) / (len(r) + len(t)) for t in texts) for r in refs]
    frame = spark.createDataFrame([("g", " ".join(r)) for r in refs], "g string, text string")
    assert lexical.rouge_l_max(df, frame, ["g"], "i", stem=None).first().rouge_l == pytest.approx(sum(best) / 2)


def test_bound_leaves_most_pairs_out():
    import random
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] for _ in range(60)]
    index = L.PredictionIndex(texts)
    for target in [texts[7][:40] + ["new"], texts[11], [], ["unknown"], *texts[20:30]]:
        assert index.best(target) == max(L.rouge_l_f1(target, t) for t in texts)
    assert index.scored < 14 * len(texts) / 4


def test_rouge_meets_every_block(spark):
    """More texts than a block on both sides, a hot group, repeated and null references, blank predictions."""
    import random
    rng = random.Random(6)
    said = lambda: " ".join(rng.choice("red green blue grey pink teal".split()) for _ in range(rng.randint(1, 9)))
    texts, refs = [said() for _ in range(3 * lexical.BLOCK_TEXTS)] + [" "], [said() for _ in range(2 * lexical.BLOCK_TEXTS)] + [None]
    refs += refs[:5]
    best = [max(L.rouge_l_f1(L.rouge_tokens(r or ""), L.rouge_tokens(t)) for t in texts) for r in refs]
    frame = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)] + [("h", 0, "red"), ("blank", 0, " ")], "g string, i int, text string")
    asked = spark.createDataFrame([("g", r) for r in refs] + [("h", "red"), ("blank", "x"), ("none", "x")], "g string, text string")
    found = {r.g: r.rouge_l for r in lexical.rouge_l_max(frame, asked, ["g"], "i", stem=None).collect()}
    assert found == {"g": pytest.approx(sum(best) / len(best)), "h": 1.0}


def test_13a_words(spark):
    assert apply(spark, lexical._words_13a, ["It's 3.5, ok-ish (yes)."]) == [["It's", "3.5", ",", "ok-ish", "(", "yes", ")", "."]]


def test_removal(spark):
    units = spark.createDataFrame([("a", "One is. Two is. Three is."), ("b", "Only one here."), ("c", "X is. Y is.")], "citer_id string, text string")
    labels = spark.createDataFrame([("a", ["METHOD", "RESULT", None]), ("b", ["OTHER"]), ("c", ["METHOD", "METHOD"])], "citer_id string, labels array<string>")
    out = removal.strip_units(units, labels, ["citer_id"]).cache()
    assert {r.citer_id: (r.kept, r.emptied) for r in out.collect()} == {
        "a": ("One is. Three is.", False), "b": ("", True), "c": ("X is. Y is.", False)}
    row = removal.removal_counters(out).first()
    assert (row.units, row.sentences, row.sentences_removed, row.emptied, row.unchanged, row.label_UNPARSED) == (3, 6, 2, 1, 1, 1)
    assert (row.last_sentence_removed, row.one_sentence_left, row.words, row.words_kept) == (1, 0, 13, 8)
    pairs = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("t", "b"), ("t", "a")], "seed_id string, citer_id string")
    kept, seeds = removal.refloor(pairs, out, 2)
    assert sorted((r.seed_id, r.citer_id, r.n_citers) for r in kept.collect()) == [("s", "a", 2), ("s", "c", 2)]
    assert removal.removal_totals(seeds).first().asDict() == {
        "seeds": 1, "pairs": 2, "pairs_dropped_emptied": 2, "seeds_dropped_under_floor": 1, "pairs_dropped_with_seed": 1}
    with pytest.raises(Exception, match="do not fit"):
        removal.strip_units(units, labels.withColumn("labels", F.slice("labels", 1, 1)), ["citer_id"]).collect()
    with pytest.raises(Exception, match="without labels"):
        removal.strip_units(units, labels.where("citer_id <> 'b'"), ["citer_id"]).collect()


def test_strip_benchmark_and_generations(spark, tmp_path):
    citer = lambda i, t: {"id": i, "title": "t", "abstract": t, "year": 2020, "fields": []}
    import json
    records = [{"seed_id": "1", "seed_title": "x", "n_citers_qualifying": 2, "part": 0, "citers": [citer("b", "B is. R is."), citer("a", "A is.")]},
               {"seed_id": "2", "seed_title": "y", "n_citers_qualifying": 1, "part": 0, "citers": [citer("a", "A is.")]}]
    (tmp_path / "in.json").write_text("\n".join(json.dumps(r) for r in records) + "\n\n")
    labels = spark.createDataFrame([("a", ["METHOD"]), ("b", ["METHOD", "RESULT"])], "citer_id string, labels array<string>")
    stats = strip.strip_benchmark(results.read_benchmark(spark, str(tmp_path / "in.json")), labels, str(tmp_path / "out"), 2)
    assert (stats["units"], stats["seeds"], stats["pairs"], stats["seeds_dropped_under_floor"]) == (2, 1, 2, 1)
    row = json.loads(spark.read.text(str(tmp_path / "out/records")).first().value)
    assert [c["id"] for c in row["citers"]] == ["b", "a"] and row["citers"][0]["abstract"] == "B is."
    assert row["citers"][0]["abstract_full"] == "B is. R is." and row["citers"][0]["sentences"][1]["removed"] is True
    gens = spark.createDataFrame([("c", "1", 0, "A is. B is."), ("c", "1", 1, "C is."), ("c", "2", 0, "D is.")], "condition string, seed_id string, gen_idx int, text string")
    gl = spark.createDataFrame([("c", "1", 0, ["RESULT", None]), ("c", "1", 1, ["OTHER"]), ("c", "2", 0, ["METHOD"])], "condition string, seed_id string, gen_idx int, labels array<string>")
    rows, counters = strip.strip_generations(gens, gl)
    assert {(r.seed_id, r.gen_idx): r.text for r in rows.collect()} == {("1", 0): "B is.", ("1", 1): "", ("2", 0): "D is."}
    assert (counters.first().seeds, counters.first().seeds_short_of_original) == (2, 1)


def test_objects_behind_and_inside_stray_braces():
    from citegraph.functions.text import listed_abstracts

    assert listed_abstracts('Set {x of {"abstract": "Blue"}') == ["Blue"]
    assert listed_abstracts('{note: {"abstract":"A"}}') == ["A"]
    assert listed_abstracts('A set { 1, 2 "open and {"abstract": "Red"} {"abstract": "Green"}') == ["Red", "Green"]
    assert listed_abstracts('{"abstract": "a } b", "more": {"abstract": "inner"}} tail {') == ["a } b"]
    assert listed_abstracts("{" * 3000) == []
