"""The registered queries against plain versions on the smallest tables."""

import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import plain  # noqa: E402

from citegraph.llm import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def result(spark, name):
    return catalogue.QUERIES[name](spark, SF).collect()


def truth(column):
    return dict(duckdb.sql(f"SELECT doc_id, {column} FROM '{SF}/labels.parquet'").fetchall())


@pytest.mark.parametrize("name, column, parts, held", [("op1_toxicity", "toxic", 3, 1), ("op2_quality", "quality", 4, 2)])
def test_classifiers(spark, docs, name, column, parts, held):
    rows = result(spark, name)
    assert sorted(r["doc_id"] for r in rows) == [i for i, _ in docs]
    labels = truth(column)
    for r in rows:
        assert r["held_out"] == (plain.fold(r["doc_id"], parts) == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    known = [r for r in rows if r["doc_id"] in labels and not r["held_out"]]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in known) >= 0.9 * len(known)


def test_mixing(spark, docs):
    rows = {r["doc_id"]: r for r in result(spark, "op3_mixing")}
    source = dict(duckdb.sql(f"SELECT doc_id, source FROM '{SF}/documents.parquet'").fetchall())
    size = {i: len(plain.words(t)) for i, t in docs}
    names = sorted({s for s in source.values() if s is not None}, key=lambda s: [ord(c) for c in s])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size[i] for i in source if source[i] == s) for s in names}
    # Water level by bisection.
    low, high = 0.0, 3.0 * sum(total.values())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * total[s], mid * weight[s]) for s in names) < sum(total.values()) else (low, mid)
    for i in source:
        assert rows[i]["size"] == size[i] and rows[i]["source_size"] == total[source[i]]
        assert math.isclose(rows[i]["target"], min(3 * total[source[i]], high * weight[source[i]]), rel_tol=1e-9)
        assert 0 <= rows[i]["taken"] <= 3 * size[i] and rows[i]["taken"] == rows[i]["copies"] * size[i]
    for s in names:
        taken = sum(rows[i]["taken"] for i in source if source[i] == s)
        target = min(3 * total[s], high * weight[s])
        untaken = [abs(size[i]) for i in source if source[i] == s]
        assert abs(taken - target) <= max(0.03 * target, min(untaken) if untaken else 0)
    again = {r["doc_id"]: r["taken"] for r in result(spark, "op3_mixing")}
    assert again == {i: r["taken"] for i, r in rows.items()}


def test_html(spark):
    import html
    import re

    rows = {r["page_id"]: r for r in result(spark, "op4_html_text")}
    for i, page in duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall():
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        body = re.sub(r"</?(?:p|h1)>", "\0", body.replace("<br>", " "))
        blocks = (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in re.sub(r"<[^>]*>", "", body).split("\0"))
        assert rows[i]["text"] == " ".join(b for b in blocks if b)
        assert rows[i]["n_chars"] == len(rows[i]["text"])


def test_near_join(spark, docs):
    expected = plain.near(docs)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["group_id"]) for r in result(spark, "op5_near_join")}
    assert got == expected


def test_brown(spark, docs):
    got = {r["doc_id"]: r for r in result(spark, "op6_brown")}
    held = held_base = 0.0
    for i, n, known, train, base in plain.base_scores(docs):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, train, plain.fold(i, 7) == 2)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        if r["held_out"]:
            held += r["score"]
            held_base += base
    assert held > held_base


def test_repeats(spark, docs):
    got = {}
    for r in result(spark, "op7_repeats"):
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    expected = plain.repeats(docs)
    assert {i: sorted(v) for i, v in got.items()} == expected
    assert sum(v[0][1] for v in expected.values()) > 0


def test_exact_dedup_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = sorted(con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({catalogue.ORACLES['op8_exact_dedup']})").fetchall())
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in result(spark, "op8_exact_dedup"))
    assert got == expected


def test_decontamination(spark, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    expected = {i: sorted(k for k, t in items if t in text) for i, text in docs}
    got = {r["doc_id"]: sorted(r["items"]) for r in result(spark, "op9_decontamination")}
    assert got == expected and any(expected.values())


def test_token_counts(spark, docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("tokenizers")
    from citegraph.llm import token_counts as T

    model = sentencepiece.SentencePieceProcessor(model_file=T.MODEL)
    vocabulary = [(model.id_to_piece(i) if not model.is_control(i) else f"\0{i}\0", model.get_score(i)) for i in range(model.get_piece_size())]
    reference = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, 0, True))
    count = lambda t: len(reference.encode(T.SPACE + t.replace(" ", T.SPACE), add_special_tokens=False).ids) if t else 0
    own = T.Counter(*T.read_pieces())
    for odd in ["", " x", "a  b\n\tc ", "☃☃ é☃", "\U0001F600\U0001F601z", "   ", "▁▁ ▁a", "tionthe " * 3000]:
        assert own.count(odd) == count(odd)
    assert {r["doc_id"]: r["n_tokens"] for r in result(spark, "op10_token_counts")} == {i: count(t) for i, t in docs}
