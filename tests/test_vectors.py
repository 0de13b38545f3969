"""Vector metrics against NumPy, with ordinary and with split (hot) groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegraph.operators import vectors as V
from citegraph.plans import characterise as CH, score


def unit(rows):
    rows = np.asarray(rows, dtype=np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def frame(spark, groups):
    rows, i = [], 0
    for key, vectors in groups.items():
        for v in vectors:
            rows.append((key, i, [float(x) for x in v]))
            i += 1
    return spark.createDataFrame(rows, "seed_id string, item_id long, vec array<double>")


def vendi(e):
    ev = np.linalg.eigvalsh(e @ e.T / len(e))
    ev = ev[ev > 1e-12]
    return np.exp(-(ev * np.log(ev)).sum())


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(0)
    return {"eye": np.eye(4), "same": unit(np.ones((4, 4))), "one": unit(rng.normal(size=(1, 4))),
            "hot": unit(rng.normal(size=(120, 4)) + 1), "mid": unit(rng.normal(size=(9, 4)))}


@pytest.mark.parametrize("block_rows", [2048, 20])
def test_vendi(spark, groups, block_rows):
    found = {r.seed_id: (r.n, r.vendi) for r in V.vendi(frame(spark, groups), block_rows=block_rows).collect()}
    assert found["eye"][1] == pytest.approx(4) and found["same"][1] == pytest.approx(1)
    for key, e in groups.items():
        assert found[key] == (len(e), pytest.approx(vendi(e), abs=1e-9))


def test_pairwise_and_dispersion(spark, groups):
    items = frame(spark, groups)
    mps = {r.seed_id: r.mps for r in V.mean_pairwise_similarity(items).collect()}
    disp = {r.seed_id: r.disp for r in V.centroid_dispersion(items).collect()}
    assert np.isnan(mps["one"]) and np.isnan(disp["one"])
    for key, e in groups.items():
        n = len(e)
        if n > 1:
            k = e @ e.T
            c = e.mean(0) / (np.linalg.norm(e.mean(0)) + 1e-12)
            assert mps[key] == pytest.approx((k.sum() - np.trace(k)) / (n * (n - 1)), abs=1e-9)
            assert disp[key] == pytest.approx(np.mean(1 - e @ c), abs=1e-9)


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_best_similarity(spark, block_rows):
    rng = np.random.default_rng(5)
    gens = {"hot": unit(rng.normal(size=(70, 4))), "mid": unit(rng.normal(size=(3, 4)))}
    goals = {"hot": unit(rng.normal(size=(90, 4))), "mid": unit(rng.normal(size=(5, 4))), "none": unit(rng.normal(size=(2, 4)))}
    found = {}
    for r in V.best_similarity(frame(spark, gens), frame(spark, goals), block_rows).collect():
        found.setdefault(r.seed_id, {})[r.item_id] = r.best_cos
    assert set(found["none"].values()) == {None}
    for key in gens:
        expected = (goals[key] @ gens[key].T).max(1)
        assert [found[key][i] for i in sorted(found[key])] == pytest.approx(list(expected), abs=1e-9)


def test_coverage(spark):
    df = spark.createDataFrame([("s", 0.9), ("s", 0.8), ("s", 0.5), ("t", None)], "seed_id string, best_cos double")
    found = {r.seed_id: (r.coverage, r.n_targets) for r in V.cosine_coverage(df).collect()}
    assert found == {"s": (pytest.approx(2.2 / 3), 3), "t": (None, 0)}
    assert {r.seed_id: r.coverage_at_tau for r in V.coverage_at(df, 0.8).collect()}["s"] == pytest.approx(2 / 3)


def test_keyed_permutation_is_one():
    for room in (1, 2, 3, 7, 100, 4097):
        drawn = CH.permuted(np.arange(room), np.full(room, room), np.full(room, -5))
        assert sorted(drawn) == list(range(room))


def test_random_sets_avoid_their_own_seed(spark):
    sizes = {1: 12, 2: 3, 3: 40}
    pairs = spark.createDataFrame([(s, 1000 * s + c) for s, n in sizes.items() for c in range(n)], "seed_id int, citer_id int")
    index, ranges = CH.indexed_pairs(pairs)
    owner = {r.idx: r.seed_id for r in index.collect()}
    assert sorted(owner) == list(range(55))
    drawn = {}
    for r in CH.random_sets(ranges, 2).collect():
        drawn.setdefault((r.seed_id, r.repeat), []).append(r.idx)
    for (seed, _), idx in drawn.items():
        assert len(idx) == len(set(idx)) == min(sizes[seed], 55 - sizes[seed])
        assert all(owner[i] != seed for i in idx)


def test_scores_and_summary(spark):
    rng = np.random.default_rng(9)
    vec = lambda: [float(x) for x in unit(rng.normal(size=(1, 4)))[0]]
    gens = spark.createDataFrame([(c, s, i, vec()) for c in "ab" for s in ("s1", "s2") for i in range(4)],
                                 "condition string, seed_id string, item_id int, vec array<double>")
    goals = spark.createDataFrame([(m, s, f"c{i}", 2024 + i, vec()) for m in ("own", "shuffled") for s in ("s1", "s2") for i in range(3)],
                                  "mode string, seed_id string, citer_id string, citer_year int, vec array<double>")
    dates = spark.createDataFrame([("c1", "2025-03-01"), ("c2", "2025-01-31")], "citer_id string, citer_pubdate string")
    scores = score.pair_scores(goals, gens, dates)
    assert scores.count() == 24
    strata = {r.stratum: r.n for r in score.with_strata(scores.where("condition = 'a' and mode = 'own'")).groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    assert strata == {"all": 6, "pre_cutoff": 4, "post_cutoff": 2, "year 2024": 2, "year 2025": 2, "year 2026": 2}
    table = score.summarise(score.with_strata(scores), n_boot=50).where("stratum = 'all' and metric = 'cosine_coverage'").collect()
    means = {(r.condition, r["mode"]): r["m"] for r in scores.groupBy("condition", "mode").agg(F.avg("best_cos").alias("m")).collect()}
    for r in table:
        assert r.mean == pytest.approx(means[r.condition, r["mode"]]) and r.ci_low <= r.mean <= r.ci_high
    seeds = score.condition_summary(score.seed_scores(gens), n_boot=50).collect()
    assert [(r.condition, r.n_seeds, r.seeds_short) for r in sorted(seeds, key=lambda r: r.condition)] == [("a", 2, 2), ("b", 2, 2)]
