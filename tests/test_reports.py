"""The one-call analyses on a small benchmark, from records to written tables."""

import pytest
from pyspark.sql import functions as F

from citegraph import schemas
from citegraph.operators import models
from citegraph.plans import reports
from citegraph.sources import results
from standins import HashedBag

WORDS = "graph model parser corpus citation author abstract network token score".split()


@pytest.fixture(scope="module")
def benchmark(spark):
    records = []
    for s in range(1, 5):
        citers = [
            {"id": str(100 * s + c), "acl_id": None, "title": "t", "abstract": " ".join(WORDS[(s + c + i) % 10] for i in range(5)),
             "year": 2016 + c, "venue": "V", "citationcount": c, "fields": ["CS"] if c else [], "isinfluential": True,
             "intents": ["background", "result"] if c % 2 else [], "n_contexts": 1}
            for c in range(3)
        ]
        records.append({
            "seed_id": str(s), "acl_id": f"P{s}", "seed_title": "x", "seed_abstract": " ".join(WORDS[s:s + 4]), "seed_authors": [],
            "seed_year": 2014 + s, "seed_venue": "V", "seed_citationcount": 10 * s, "seed_influentialcitationcount": s,
            "seed_fields": ["CS"], "n_citers_qualifying": 3, "citers": citers, "part": 0,
        })
    return results.benchmark_rows(spark.createDataFrame(records, schemas.BENCHMARK))


def read(spark, path):
    return spark.read.option("header", True).option("inferSchema", True).csv(str(path)).collect()


def generations(spark, seeds=(1, 2, 3, 4)):
    rows = [(c, str(s), i, " ".join(WORDS[(s + i + j + len(c)) % 10] for j in range(4))) for c in ("gemma_t10", "own") for s in seeds for i in range(3)]
    rows.append(("own", "9", 0, "only in one condition"))
    return spark.createDataFrame(rows, "condition string, seed_id string, gen_idx int, text string")


def test_score_report(spark, benchmark, tmp_path):
    citers = spark.createDataFrame([(101, "2025-03-01"), (102, None)], "corpusid long, publicationdate string")
    matches = benchmark.select(
        F.lit("gemma_t10").alias("condition"), F.lit("own").alias("mode"), "seed_id", F.col("citer.id").alias("citer_id"),
        F.array(*[F.lit(x).cast("float") for x in (0.9, 0.2, 0.6)]).alias("probs"),
    )
    out = tmp_path / "score"
    reports.score_report(benchmark, generations(spark), citers, HashedBag, "bag", str(tmp_path / "cache"), str(out), matches, 50)
    assert len(read(spark, out / "per_seed")) == 8
    pairs = read(spark, out / "per_pair")
    assert len(pairs) == 48 and {r.m for r in pairs if r.condition == "gemma_t10" and r["mode"] == "own"} == {2}
    assert {r.m for r in pairs if r["mode"] == "shuffled"} == {None}
    curve = {(r.condition, r.k): r.recall for r in read(spark, out / "recall_curve")}
    assert curve["gemma_t10", 1] == pytest.approx(2 / 3) and curve["gemma_t10", 51] == 1.0
    assert [r.best_condition for r in read(spark, out / "best")] == ["gemma_t10"]
    sizes = {(r.condition, r["mode"], r.stratum): r.n_pairs for r in read(spark, out / "sizes")}
    assert sizes["own", "own", "all"] == 12 and sizes["own", "own", "post_cutoff"] == 1


def test_contrast_report(spark, benchmark, tmp_path):
    gens = generations(spark).where("seed_id <> '9'").withColumn("system", F.concat(F.lit("m/"), "condition")).drop("condition")
    bag = models.embed(gens.select(F.concat_ws("|", "system", "seed_id", "gen_idx").alias("text_key"), "text"), HashedBag)
    vectors = bag.select(F.split("text_key", r"\|").alias("k"), "vec").select(
        F.col("k")[0].alias("system"), F.col("k")[1].alias("seed_id"), F.col("k")[2].alias("item_id"), "vec"
    )
    seeds = benchmark.select("seed_id", F.col("seed_abstract").alias("text")).distinct()
    seed_vecs = models.embed(seeds.withColumnRenamed("seed_id", "text_key"), HashedBag).select(F.col("text_key").alias("seed_id"), F.col("vec").alias("seed_vec"))
    per_seed = gens.select("system", "seed_id").distinct().withColumn("coverage", F.rand(1)).withColumn("vendi", F.rand(2))
    table = reports.set_metrics(gens, vectors, seeds.join(seed_vecs, "seed_id"), per_seed).cache()
    assert table.count() == 8 and table.where("mps is null or self_bleu is null or seed_sim is null or rougeL_seed is null").count() == 0
    pairs = spark.range(100).select(F.lit("m/own").alias("system"), F.col("id").alias("seed_id"), F.lit(0).alias("citer_id"), (F.col("id") / 100).alias("seed_sim"), (F.col("id") / 100).alias("best_cos"))
    reports.contrast_report(table, pairs, 0.5, str(tmp_path / "c"))
    assert sorted(r.coverage for r in read(spark, tmp_path / "c/deciles")) == [0.0] * 5 + [1.0] * 5
    assert len(read(spark, tmp_path / "c/rankings")) == 2 * 9 and len(read(spark, tmp_path / "c/systems")) == 2


def test_characterise_report(spark, benchmark, tmp_path):
    sims = benchmark.select("seed_id", F.col("citer.id").alias("citer_id"), (F.col("citer.year") / 10000).alias("sim"))
    reports.characterise_report(benchmark, str(tmp_path / "r"), sims=sims)
    row = read(spark, tmp_path / "r/covariates")[0]
    assert row.same_field_frac == pytest.approx(2 / 3) and row.influential_frac == 1
    assert {r.intent: r.n for r in read(spark, tmp_path / "r/intents")} == {"unknown": 8, "background/result": 4}
    assert {r.stratum: r.n for r in read(spark, tmp_path / "r/similarity")}["all"] == 12
    assert [(r.n_citers, r.cum_pairs) for r in read(spark, tmp_path / "r/concentration")] == [(3, 12)]
