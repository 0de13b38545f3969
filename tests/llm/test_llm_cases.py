"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; hot groups on the split paths."""

import math
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import plain  # noqa: E402

from citegraph.llm import (  # noqa: E402
    brown, decontaminate, exact_dedup, groups, html_text, mixing, near_join, quality, repeats, token_counts, toxicity,
)
from citegraph.llm.common import materialise  # noqa: E402
from citegraph.llm.lyndon import suffix_arrays  # noqa: E402

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("ren", "lis", "tom", "nak", "s", "v")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    long = prose(rng, 9000)
    shared = prose(rng, 60)
    rows = [(1, None), (2, ""), (None, prose(rng, 80)), (3, long), (4, "one two"), (4, "one two"), (5, "One TWO"), (6, long), (7, "   \n\t "),
            (8, prose(rng, 30) + " " + shared), (9, shared + " " + prose(rng, 30)), (10, "Ünïcode ☃ " * 20), (None, None), (12, "x" * 5000)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    rows = [(i, t, "en", None if n % 4 == 0 else f"s{n % 3}", 0, 1.5, 7, "k", 2) for n, (i, t) in enumerate(odd_rows)]
    # Extra columns with names the operators use themselves.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, _row long, digest string, copies int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(3, None, None)], "doc_id long, quality int, toxic int")


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


def test_odd_texts_keep_one_row_each(odd, odd_rows, labels):
    expected = sorted((i is None, i or 0) for i, _ in odd_rows)
    for out in (
        toxicity.score_toxicity(odd, labels), quality.score_quality(odd, labels), mixing.mix(odd), near_join.near_join(odd), brown.score_lm(odd),
        repeats.remove_repeats(odd), exact_dedup.exact_dedup(odd), token_counts.count_tokens(odd),
        decontaminate.find_leaks(odd, odd.select(F.col("doc_id").alias("item_id"), "text")),
    ):
        assert ids(out.collect()) == expected


def test_empty_tables(spark, odd, labels):
    none, no_labels = odd.limit(0), labels.limit(0)
    for out in (
        toxicity.score_toxicity(none, labels), quality.score_quality(none, labels), mixing.mix(none), near_join.near_join(none), brown.score_lm(none),
        repeats.remove_repeats(none), exact_dedup.exact_dedup(none), token_counts.count_tokens(none), exact_dedup.drop_copies(none),
        decontaminate.find_leaks(none, odd.select(F.col("doc_id").alias("item_id"), "text")), near_join.keep_one(none), mixing.mixed_rows(none),
    ):
        assert out.collect() == []
    assert {r["score"] for r in quality.score_quality(odd, no_labels).collect()} == {0.5}
    assert not any(r["predicted"] for r in toxicity.score_toxicity(odd, no_labels).collect())
    nothing = decontaminate.find_leaks(odd, spark.createDataFrame([], "item_id long, text string"))
    assert not any(r["contaminated"] for r in nothing.collect())


def test_stage_functions_keep_columns(odd, labels):
    for out in (exact_dedup.drop_copies(odd), near_join.keep_one(odd), quality.keep_good(odd, labels),
                decontaminate.drop_leaks(odd, odd.select(F.col("doc_id").alias("item_id"), "text").limit(1))):
        assert out.columns == odd.columns
        out.collect()
    assert mixing.mixed_rows(odd).columns == [*odd.columns, "copies0", "shard", "place"]


def test_exact_dedup_ties(odd):
    rows = exact_dedup.exact_dedup(odd).collect()
    one_two = [r for r in rows if r["doc_id"] in (4, 5)]
    assert {r["keep_id"] for r in one_two} == {5} and {r["group_size"] for r in one_two} == {3}
    empties = [r for r in rows if r["keep_id"] == 2]
    assert len(empties) == 3 and [r["doc_id"] for r in empties if r["kept"]] == [2]
    kept = exact_dedup.drop_copies(odd).collect()
    assert len(kept) == sum(r["kept"] for r in rows) and len({(r["text"] or "").lower() for r in kept}) == len(kept)


@pytest.mark.parametrize("support", [0.9, 0.002])
def test_exact_dedup_hot_digest(spark, support):
    hot = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "Same text").otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("long"))).alias("text"))
    rows = exact_dedup.exact_dedup(hot, "id", support=support).collect()
    assert len(rows) == 3000
    assert sum(r["kept"] for r in rows if r["group_size"] == 1000) == 1
    assert max(r["doc_id"] for r in rows if r["group_size"] == 1000) == next(r["keep_id"] for r in rows if r["group_size"] == 1000)


def test_near_join_groups_by_blocks(spark, monkeypatch):
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(i % 3):
            copy[rng.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, prose(rng, 40)) for i in range(20)] + [(200, rows[3][1]), (201, "a b"), (202, "A b"), (203, "a b c")]
    monkeypatch.setattr(near_join, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(near_join, "GROUP_BLOCK", 16)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["group_id"]) for r in near_join.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain.near(rows)
    kept = {r["doc_id"] for r in near_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k][0] for k in kept if k < 60 or k == 200} == {got[i][2] for i in range(60)}


def test_depth_shortens_to_recall():
    deep, shallow = near_join.depth_for(0.95), near_join.depth_for(0.6)
    assert deep > shallow and 1 - (1 - 0.8 ** near_join.depth_for()) ** near_join.TREES >= near_join.RECALL


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}


def test_suffix_arrays_of_many_strings():
    rng = random.Random(1)
    for _ in range(60):
        texts = [[rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 40))] + [0] for _ in range(rng.randint(1, 6))]
        sa = suffix_arrays(np.array(sum(texts, []), np.int16), np.array([len(t) for t in texts]))
        at = 0
        for t in texts:
            assert (sa[at:at + len(t)] - at).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
            at += len(t)


@pytest.mark.parametrize("wide", [1, 48])
def test_repeats_of_odd_and_hot_texts(spark, odd_rows, wide, monkeypatch):
    rng = random.Random(4)
    line = prose(rng, 14)
    rows = [*odd_rows, *[(1000 + i, f"{prose(rng, 12)} {line} {prose(rng, 9)}") for i in range(120)], *[(2000 + i, line * 2) for i in range(5)]]
    monkeypatch.setattr(repeats, "WIDE", wide)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(repeats, "BATCH", 3_000)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in repeats.remove_repeats(frame, texts_out=True).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
        assert len(r["kept"]) == r["n_bytes"] - r["n_removed"]
    assert {i: sorted(v) for i, v in got.items()} == plain.repeats(rows)


def test_brown_on_odd_texts(spark, odd, odd_rows):
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in brown.score_lm(odd).collect())
    assert got == sorted((i or -1, n, k, round(b, 6)) for i, n, k, _, b in plain.base_scores(odd_rows))
    only_held = spark.createDataFrame([(i, "a b") for i in range(40) if plain.fold(i, 7) == 2], "doc_id long, text string")
    rows = brown.score_lm(only_held).collect()
    assert rows and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == r["base_score"] for r in rows)


def test_brown_is_a_distribution():
    """Within a class, seen words and the unseen mass add up to one."""
    counts = np.array([5.0, 3, 1, 1])
    assert math.isclose(((counts - brown.DISCOUNT) / counts.sum()).sum() + brown.DISCOUNT * len(counts) / counts.sum(), 1.0)


def test_decontamination_of_new_parameters(spark):
    items = spark.createDataFrame([
        (1, "A farmer called Miller sells 12 kg of apples for 30 dollars and then Miller buys 5 kg of pears at the market"),
        (2, "tiny item"), (3, "x"), (4, None), (5, "the quick red fox jumps over the old dog near the river bank"),
    ], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Intro words. A farmer called Baker sells 99 kg of apples for 7 dollars and then Baker buys 4 kg of pears at the market. More."),
        (2, "A farmer called Baker sells 99 kg of apples for 7 dollars and then Cooper buys 4 kg of pears at the market"),
        (3, "THE QUICK RED FOX JUMPS OVER THE OLD DOG NEAR THE RIVER BANK"), (4, "the quick red fox ran home and slept near the river all day long"),
        (5, "nothing"), (6, None), (1, "other text of the same id"), (7, "here is a tiny item indeed"),
    ], "doc_id long, text string")
    got = sorted((r["doc_id"], r["items"]) for r in decontaminate.find_leaks(docs, items).collect())
    assert got == [(1, []), (1, [1]), (2, []), (3, [5]), (4, []), (5, []), (6, []), (7, [])]
    assert len(decontaminate.drop_leaks(docs, items).collect()) == 6


def test_decontamination_of_an_edited_verbatim_copy(spark):
    """One changed capitalised word that recurs in the item takes its template windows away, never the verbatim ones."""
    item = ("The old mill by the river grinds corn for every village in the valley. "
            "The miller sleeps under a wide oak tree while slow water turns his heavy wheel all day")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    edited = item.replace(". The", ". An")
    docs = spark.createDataFrame([(1, f"intro {edited} outro"), (2, f"intro {item} outro"), (3, "An old mill by")], "doc_id long, text string")
    got = {r["doc_id"]: (r["items"], r["covered"]) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got[1][0] == [1] and math.isclose(got[1][1], 30 / 31) and got[2] == ([1], 1.0) and got[3] == ([], 0.0)
    assert [r["doc_id"] for r in decontaminate.drop_leaks(docs, items).collect()] == [3]


def test_decontamination_without_the_filter(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, prose(rng, 20)) for i in range(5)]
    docs = [(i, prose(rng, 30) + " " + (items[i % 5][1] if i % 3 == 0 else "") + " " + prose(rng, 30)) for i in range(30)]
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    first = sorted((r["doc_id"], r["items"]) for r in decontaminate.find_leaks(*args).collect())
    monkeypatch.setattr(decontaminate, "FILTER_WINDOWS", 0)
    assert sorted((r["doc_id"], r["items"]) for r in decontaminate.find_leaks(*args).collect()) == first
    assert {i for i, k in first if k} == {i for i, _ in docs if i % 3 == 0}


def test_field_recursions_match_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 1, 5])
    unary, transition, start = rng.normal(size=9), rng.normal(size=(2, 2)), 0.4
    got = toxicity.marginals(unary, lengths, transition, start)
    at = 0
    for n in lengths:
        total, on = 0.0, np.zeros(n)
        for code in range(2**n if n else 0):
            y = [(code >> k) & 1 for k in range(n)]
            w = math.exp(start * y[0] + sum(u for u, b in zip(unary[at:at + n], y) if b) + sum(transition[a, b] for a, b in zip(y, y[1:])))
            total += w
            on += w * np.array(y)
        if n:
            assert np.allclose(got[at:at + n], on / total)
        at += n


def test_toxic_spans(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 25) + (" GRUNFIX " if i % 4 == 0 else " ") + prose(rng, 25)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    for r in toxicity.score_toxicity(docs, labels).collect():
        assert r["predicted"] == int(r["doc_id"] % 4 == 0)
        text = dict(rows)[r["doc_id"]]
        assert [text[s["start"]:s["end"]] for s in r["spans"]] == (["GRUNFIX"] if r["predicted"] else [])


def test_isotonic():
    knots, levels = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([1.0, 0, 3, 4]), np.array([4.0, 4, 4, 4]))
    assert (np.diff(levels) >= 0).all() and math.isclose(levels[0], 1 / 8) and levels[-1] == 1.0
    assert len(knots) == len(levels)


def test_mixing_targets_and_tree(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(mixing.weighted(sizes, (5, 2, 1))).collect()}
    assert got["a"] == 30.0 and got[None] == 0.0
    assert math.isclose(got["b"], 1980 * 2 / 3) and math.isclose(got["c"], 1980 / 3)
    quotas = mixing.quotas(spark.createDataFrame([("a", 37), ("b", 256), (None, 3)], "source string, n_blocks long"), 4).collect()
    for source, n in (("a", 37), ("b", 256), (None, 3)):
        assert sum(r["quota"] for r in quotas if r["source"] == source) == n
    shards = [sum(r["quota"] for r in quotas if r["shard"] == s) for s in range(16)]
    assert sum(shards) == 296 and max(shards) - min(shards) <= 1


def test_mixing_goes_on_past_a_long_document(spark):
    """Short free documents fill what a long one leaves open."""
    sizes = [("s0", 7)] * 100 + [(f"s{k}", n) for k in range(1, 8) for n in [3] * 100 + [130]]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, weights=(7, 1, 1, 1, 1, 1, 1, 1)).collect()
    assert len(rows) == len(sizes)
    for k in range(1, 8):
        own = [r for r in rows if r["source"] == f"s{k}"]
        assert own[0]["target"] == 265.0 and abs(sum(r["taken"] for r in own) - 265) < 3
        assert all(r["copies"] in (0, 1) and (r["shard"] is None) == (r["copies"] == 0) for r in own)


def test_hypergeometric_follows_its_law(spark):
    draws = spark.range(4000).select(mixing.hypergeometric(F.lit(10), F.lit(8), F.lit(12), mixing.uniform(1, F.col("id"))).alias("x")).collect()
    x = np.array([r["x"] for r in draws])
    assert x.min() >= 0 and x.max() <= 8
    assert abs(x.mean() - 4.0) < 0.1 and abs(x.var() - 10 * 0.4 * 0.6 * 10 / 19) < 0.15


PAGE = """<html><body><div id=top class="site-header"><a href=/>Home</a></div><nav><ul><li>One<li>Two</ul></nav>
<div class="post-{n}"><h1>Title {n} &amp; more</h1><p>First <b>paragraph</b>   of page {n}, long enough to count as text of its own.<br>Next line
<p>Second&nbsp;paragraph with &lt;tags&gt; and a <a href=x>link</a>.<div class="cookie-notice">We use cookies</div><form>Name <input></form>
<script>if (a < b) {{ document.write("<p>no</p>") }}</script><style>p {{}}</style><ul><li>Item a<li>Item b</ul></div>
<div class="comments"><p>A reader comment that is long, longer than the article itself, and goes on and on about nothing at all, really.</p></div>
<aside>Side</aside><footer>Foot</footer></body></html>"""


def test_html_cases(spark):
    pages = [(n, f"https://www.host.example/{n}", PAGE.format(n=n)) for n in range(6)] + [
        (10, None, None), (11, "not a url", "plain &amp; simple"), (12, "http://x.example", "<p>unclosed <b>tags"), (13, "http://x.example", "<div hidden>gone</div>"),
        (14, "http://x.example", '<p title="a > b">kept</p><!-- <p>not</p> -->'), (None, "http://x.example", "<nav>menu only</nav>")]
    got = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for n in range(6):
        assert got[n]["text"] == (
            f"Title {n} & more First paragraph of page {n}, long enough to count as text of its own. Next line "
            "Second paragraph with <tags> and a link. Item a Item b")
    assert [got[n]["text"] for n in (10, 11, 12, 13, 14, None)] == ["", "plain & simple", "unclosed tags", "", "kept", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_html_host_votes_decide(spark):
    """A page whose sidebar outweighs its article follows the host."""
    usual = "<body><div class=story><p>{}</p></div><div class=extra><p>short</p></div></body>"
    page = usual.format("Main text " * 30)
    odd = "<body><div class=story><p>{}</p></div><div class=extra><p>{}</p></div></body>".format("Main text " * 20, "Other text " * 32)
    rows = [(n, "http://h.example/a", page) for n in range(9)] + [(9, "http://h.example/b", odd)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == ("Main text " * 20).strip() and got[0] == ("Main text " * 30).strip()


def test_html_keeps_what_stands_beside_the_body(spark):
    """Title, lead and further sections around a large inner container, inside and outside of an article, and where hosts mix both."""
    body = "<p>" + "Main text " * 40 + "</p>"
    text = ("Main text " * 40).strip()
    layouts = {
        "a": f"<article><h1>Title</h1><p>Lead</p><div class='article-body'>{body}</div></article>",
        "b": f"<article><section class=x>{body}</section><section class=y><p>Title</p><p>Lead</p></section></article>",
        "c": f"<div class=page><h1>Title</h1><p>Lead</p><div class=wrap><div class=text>{body}</div></div></div>",
        "d": f"<div class=page><section class=x>{body}</section><section class=y><p>Title</p><p>Lead</p></section></div>",
        "e": f"<main><h1>Title</h1><p>Lead</p><article>{body}</article></main>",
    }
    side = "<nav>Menu</nav>{}<div class=extra><p>short</p></div><footer>Foot</footer>"
    rows = [(f"{k}{n}", f"http://{k}.example/{n}", f"<body>{side.format(layout)}</body>") for k, layout in layouts.items() for n in range(4)]
    bare = f"<div class=page><div class=wrap><div class=text>{body}</div></div></div>"
    rows += [(f"m{n}", f"http://m.example/{n}", f"<body>{side.format(layouts['c'] if n == 0 else bare)}</body>") for n in range(8)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    for k in layouts:
        expected = f"{text} Title Lead" if k in "bd" else f"Title Lead {text}"
        assert {got[f"{k}{n}"] for n in range(4)} == {expected}, k
    assert got["m0"] == f"Title Lead {text}" and {got[f"m{n}"] for n in range(1, 8)} == {text}


def test_token_counts_of_a_small_vocabulary():
    """Ties: of equal paths the one whose last piece is longer wins; unknown runs without byte fallback count once."""
    counter = token_counts.Counter({"a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0, "▁": -1.0}, -2.0, False)
    assert counter.count("ab") == 2 and counter.count("aba") == 3
    assert counter.count("a??b") == 4 and counter.count("?") == 2
    with_bytes = token_counts.Counter({"a": -1.0, "▁": -1.0}, -2.0, True)
    assert with_bytes.count("é") == 3


def shuffled_mb(spark, run):
    """MB written by the shuffles of ``run``."""
    context = spark.sparkContext

    def written():
        stages = context._jsc.sc().statusStore().stageList(
            None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) / 1e6

    before = written()
    run().write.format("noop").mode("overwrite").save()
    return written() - before


def test_stages_shuffle_no_whole_texts(spark):
    """Texts stay where they are, but for those a stage may drop."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(8_000)) for _ in range(380)]
    docs = materialise(spark.createDataFrame([(i, texts[i % 380]) for i in range(384)], "doc_id long, text string").repartition(4))
    items = spark.createDataFrame([(1, texts[7][:300])], "item_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows, run in ((380, lambda: exact_dedup.drop_copies(docs)), (384, lambda: near_join.keep_one(docs)), (383, lambda: decontaminate.drop_leaks(docs, items))):
            assert run().count() == rows
            assert shuffled_mb(spark, run) < 0.5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_mixed_rows_are_those_of_the_mix(spark):
    docs = materialise(spark.createDataFrame(
        [(None if i % 50 == 0 else i % 900, "w " * (1 + i * 7 % 60), None if i % 4 == 0 else f"s{i % 4}") for i in range(1_000)],
        "doc_id long, text string, source string"))
    stored = docs.withColumn("_row", F.monotonically_increasing_id())
    told = mixing.mix(stored, row_col="_row").where("copies > 0").join(stored.select("_row", "text"), "_row")
    names = ["doc_id", "text", "source", "copies", "shard", "place"]
    assert sorted(map(str, mixing.mixed_rows(docs).select(names).collect())) == sorted(map(str, told.select(names).collect()))
