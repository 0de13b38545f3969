"""The pipeline against a plain version of every stage after the classifier, and the registration of all queries."""

import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(__file__))
import plain  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from citegraph.llm import catalogue  # noqa: E402
from citegraph.llm.common import materialise, table  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in catalogue.QUERIES} == set(range(1, 14))
    assert set(catalogue.QUERIES) | {"pipeline"} <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing to target weights"]


def test_stages_against_plain(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    quality, exact, near, leaks, mixture = [f for _, f in corpus_pipeline.STAGES]
    docs = materialise(quality(spark, docs, SF))
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wrong = [i for i, q in labels.items() if (i in dict(rows)) != bool(q)]
    assert docs.columns == columns and len(wrong) <= 0.1 * len(labels)

    docs = materialise(exact(spark, docs, SF))
    largest = {}
    for i, t in rows:
        key = t.translate(plain.LOWER)
        largest[key] = max(largest.get(key, i), i)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert docs.columns == columns and sorted(i for i, _ in rows) == sorted(largest.values())

    docs = materialise(near(spark, docs, SF))
    expected = sorted(i for i, (own, _, group) in plain.near(rows).items() if own == group)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert docs.columns == columns and sorted(i for i, _ in rows) == expected

    docs = materialise(leaks(spark, docs, SF))
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    expected = sorted(i for i, t in rows if not any(x in t for x in items))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert docs.columns == columns and sorted(i for i, _ in rows) == expected

    out = mixture(spark, docs, SF)
    mixed = out.collect()
    assert out.columns == [*columns, "copies", "shard", "place"]
    assert {r["doc_id"] for r in mixed} <= {i for i, _ in rows} and all(1 <= r["copies"] <= 3 for r in mixed)
    taken = sum(r["copies"] * len(plain.words(r["text"])) for r in mixed)
    assert abs(taken - sum(len(plain.words(t)) for _, t in rows)) <= 0.05 * taken
