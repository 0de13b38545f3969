"""Raw shards, bucketed layers, resumable work and result files."""

import gzip
import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from citegraph import cli, params
from citegraph.operators import models
from citegraph.plans import cut
from citegraph.plans.generate import generate
from citegraph.sources import layers, results
from citegraph.streaming.ingest import BrokenShards, append_new, ingest, ingest_with_verdicts, shard_verdicts
from standins import HashedBag, KeywordRoles, WordOverlap


# Back ends defined in this file travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shard(path, records, raw=()):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.write("\n".join([json.dumps(r) for r in records] + list(raw)) + "\n")


PAPERS = [
    {"corpusid": 1, "externalids": {"ACL": "P1", "DOI": "", "ArXiv": None}, "title": "one", "authors": [{"name": "A"}, {"name": ""}, {"name": None}, None],
     "year": 2015, "publicationdate": "", "venue": "", "journal": {"name": "J"}, "influentialcitationcount": 3,
     "s2fieldsofstudy": [{"category": "Z"}, {"category": "B"}, {"category": "Z"}, {"category": None}], "isopenaccess": True},
    {"corpusid": 2, "externalids": None, "title": "two", "authors": [], "journal": "plain text", "s2fieldsofstudy": None, "year": None},
    {"corpusid": None, "title": "no id"},
    {"corpusid": 66, "externalids": {"ACL": ""}, "authors": None, "journal": None, "title": ""},
]


def test_papers_are_normalised(spark, tmp_path):
    shard(tmp_path / "p/a.gz", PAPERS)
    raw = layers.read_shards(spark, "papers", str(tmp_path / "p/*.gz"))
    rows = {r.corpusid: r for r in layers.paper_rows(raw).collect()}
    assert set(rows) == {1, 2, 66}
    one = rows[1]
    assert (one.acl_id, one.doi, one.arxiv, one.authors, one.s2fieldsofstudy) == ("P1", None, None, ["A"], ["B", "Z"])
    assert (one.publicationdate, one.venue, one.journal_name, one.isopenaccess) == (None, None, "J", True)
    assert rows[2].authors is None and rows[2].journal_name is None and rows[66].acl_id is None and rows[66].title == ""
    assert [r.corpusid for r in layers.id_rows(raw).collect()] == [1]


def test_malformed_lines(spark, tmp_path):
    shard(tmp_path / "e/a.gz", [{"citedcorpusid": 5, "citingcorpusid": None}, {"citedcorpusid": None, "citingcorpusid": 6}], ["{broken"])
    path = str(tmp_path / "e/*.gz")
    with pytest.raises(Exception):
        layers.read_shards(spark, "citers", path).collect()
    good, bad = layers.quarantine(layers.read_shards(spark, "citers", path, strict=False).cache())
    assert [r.citedcorpusid for r in layers.edge_rows(good).collect()] == [5] and [r[0] for r in bad.collect()] == ["{broken"]


def test_ingest_is_incremental_and_compaction_keeps_rows(spark, tmp_path):
    source, dest, mark = tmp_path / "raw", str(tmp_path / "layer"), str(tmp_path / "mark")
    shard(source / "a.gz", [{"corpusid": i, "abstract": f"t{i}"} for i in (1, 65, -63, 2)] + [{"corpusid": None}])
    assert ingest(spark, "abstracts", str(source), dest, mark) == 4
    assert ingest(spark, "abstracts", str(source), dest, mark) == 0
    shard(source / "b.gz", [{"corpusid": 130, "abstract": "t130"}])
    assert ingest(spark, "abstracts", str(source), dest, mark) == 1
    ids = lambda df: sorted(r.corpusid for r in df.collect())
    assert ids(layers.read_bucketed(spark, "abstracts", dest)) == [-63, 1, 2, 65, 130]
    assert ids(layers.read_bucketed(spark, "abstracts", dest, [1])) == [-63, 1, 65]
    assert ids(layers.read_bucketed(spark, "abstracts", dest, [])) == []
    out = str(tmp_path / "compact")
    assert layers.compact(spark, "abstracts", dest, out, files=3) == 5
    stored = layers.read_bucketed(spark, "abstracts", out, hide_bucket=False)
    assert ids(stored) == [-63, 1, 2, 65, 130]
    lookup = layers.with_bucket_filter(stored, "corpusid", 65)
    assert ids(lookup) == [65]
    plan = lookup._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "(bucket" in plan.split("PartitionFilters")[1]


def test_two_checkpoints_keep_their_loads_apart(spark, tmp_path):
    dest = str(tmp_path / "layer")
    for name, ids in (("one", (1, 2, 3)), ("two", (10, 11))):
        shard(tmp_path / name / "a.gz", [{"corpusid": i, "abstract": "t"} for i in ids])
        assert ingest(spark, "abstracts", str(tmp_path / name), dest, str(tmp_path / f"mark-{name}")) == len(ids)
    assert sorted(r.corpusid for r in layers.read_bucketed(spark, "abstracts", dest).collect()) == [1, 2, 3, 10, 11]


def test_a_bad_line_does_not_stop_the_shards(spark, tmp_path):
    source, dest, bad = tmp_path / "raw", str(tmp_path / "layer"), str(tmp_path / "bad")
    shard(source / "a.gz", [{"corpusid": 1, "abstract": "t"}], ["{broken"])
    shard(source / "b.gz", [{"corpusid": 2, "abstract": "t"}])
    with pytest.raises(Exception):
        ingest(spark, "abstracts", str(source), str(tmp_path / "strict"), str(tmp_path / "mark-strict"))
    assert ingest(spark, "abstracts", str(source), dest, str(tmp_path / "mark"), bad_lines=bad) == 2
    assert sorted(r.corpusid for r in layers.read_bucketed(spark, "abstracts", dest).collect()) == [1, 2]
    rows = spark.read.json(bad).collect()
    assert [(r._shard.rsplit("/", 1)[1], r.line) for r in rows] == [("a.gz", "{broken")]


def test_corpus_build_resumes(spark, tmp_path):
    root = tmp_path / "derived"
    shard(tmp_path / "raw/p.gz", [PAPERS[0], {"corpusid": 3, "title": "three", "year": 2016}, {"corpusid": 65, "externalids": {"ACL": "Q"}, "title": "q"}])
    papers = layers.paper_rows(layers.read_shards(spark, "papers", str(tmp_path / "raw/p.gz")))
    layers.write_bucketed(papers, "papers", str(root / "papers"))
    abstracts = spark.createDataFrame([(1, "abs"), (65, "abs q")], "corpusid long, abstract string")
    layers.write_bucketed(abstracts, "abstracts", str(root / "abstracts"))
    edges = spark.createDataFrame([(1, 3, 1, True, None, None), (1, 3, 1, False, ["c"], None), (2, 3, 65, None, None, None), (3, 1, 2, True, None, None)],
                                  "citationid long, citingcorpusid long, citedcorpusid long, isinfluential boolean, contexts array<string>, intents array<array<string>>")
    layers.write_bucketed(edges, "citers", str(root / "citers"))
    out = str(tmp_path / "corpus")
    assert cut.build_corpus(spark, str(root), out, ("seeds", "edges"), buckets=[2]) == {"seeds": 2, "edges": 0}
    assert cut.build_corpus(spark, str(root), out) == {"seeds": 2, "edges": 2, "citers": 1}
    assert cut.build_corpus(spark, str(root), out) == {"seeds": 2, "edges": 2, "citers": 1}
    row = spark.read.parquet(f"{out}/edges").where("citedcorpusid = 1").first()
    assert (row.isinfluential, row.contexts) == (True, ["c"])


def test_generation_logs(spark, tmp_path):
    line = lambda seed, texts, cond="gptoss": json.dumps({"seed_id": seed, "condition": cond, "model": "m", "predictions": texts})
    (tmp_path / "gptoss").mkdir()
    (tmp_path / "own").mkdir()
    (tmp_path / "gptoss/shard_0_of_2.jsonl").write_text(line("1", ["old"]) + "\n" + line("1", ["a", "", "b"]) + "\n\n")
    (tmp_path / "gptoss/shard_1_of_2.jsonl").write_text(line("2", ["x"]) + "\n" + '{"seed_id": "9", "cond')
    (tmp_path / "own/shard_0_of_1.jsonl").write_text(line("1", ["z"], "own") + "\n")
    (tmp_path / "own/shard_0_of_1.jsonl.processed").write_text("1\n")
    found = {(r.condition, r.seed_id): (r.predictions, r.order) for r in results.read_generations(spark, str(tmp_path)).collect()}
    assert found == {("gptoss", "1"): (["a", "b"], 4), ("gptoss", "2"): (["x"], 4), ("own", "1"): (["z"], 6)}
    kept = results.read_generations(spark, str(tmp_path), keep_empty=True).where("seed_id = '1' and condition = 'gptoss'").first()
    assert kept.predictions == ["a", "", "b"]


def test_json_round_trip_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, [1, 2])], "a int, b array<int>")
    layers.write_json_lines(df, str(tmp_path / "j"))
    assert sorted(spark.read.schema(df.schema).json(str(tmp_path / "j")).collect()) == sorted(df.collect())
    assert any('"b":null' in r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    scores = spark.createDataFrame([("c", "own", "1", "2", 2020, None, 51, None, 0.5)], results.schemas.PAIR_SCORE)
    layers.write_csv(scores, str(tmp_path / "c"), gzip=True)
    assert results.read_scores(spark, str(tmp_path / "c")).collect() == scores.collect()


def test_matches_and_missing_units(spark, tmp_path):
    rows = [("a", "own", "1", "2", 2, [0.1, 0.9, float("nan")]), ("b", "own", "1", "2", 1, [0.2])]
    results.write_matches(spark.createDataFrame(rows, results.schemas.MATCH_ROW), str(tmp_path / "m"))
    stored = results.read_matches(spark, str(tmp_path / "m"))
    assert {r.condition: len(r.probs) for r in stored.collect()} == {"a": 2, "b": 1}
    wanted = spark.createDataFrame([("a", "own"), ("a", "shuffled")], "condition string, mode string")
    assert [(r.condition, r["mode"]) for r in results.missing_units(wanted, stored).collect()] == [("a", "shuffled")]


def test_review_table(spark, tmp_path):
    (tmp_path / "r.md").write_text("## 1. A title\n| # | second | ref | sentence |\n|---|---|---|---|\n| 0 | **RESULT** | METHOD | a \\| b |\n")
    row = results.read_review(spark, str(tmp_path / "r.md")).first()
    assert (row.sentence, row.second, row.reference, row.text) == (0, "RESULT", "METHOD", "a | b")


class CountingBag(HashedBag):
    """Encoder that leaves a file per encoded text, to see what reached it."""

    folder = None

    def __init__(self, folder):
        super().__init__(8)
        self.folder = folder

    def encode(self, texts):
        for t in texts:
            with open(f"{self.folder}/{t}", "a") as f:
                f.write("x")
        return super().encode(texts)


def test_embedding_cache(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    factory = lambda folder=str(seen): CountingBag(folder)
    texts = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, text string")
    first = models.embed_cached(texts("ab", "abc", "ab"), factory, str(tmp_path / "cache"), "enc").collect()
    assert len(first) == 3 and sorted(p.name for p in seen.iterdir()) == ["ab", "abc"]
    second = {r.text: r.vec for r in models.embed_cached(texts("abc", "abcd", "ab"), factory, str(tmp_path / "cache"), "enc").collect()}
    assert {p.name: p.read_text() for p in seen.iterdir()} == {"ab": "x", "abc": "x", "abcd": "x"}
    assert second["ab"] == first[0].vec
    assert models.embed_cached(texts().where("i < 0"), factory, str(tmp_path / "none"), "enc").count() == 0


class Stutter:
    """Generator whose first reply per call is only a label, which is cleaned to nothing."""

    def sample(self, prompts, n_calls, settings):
        assert "abstract" in settings["system"]
        return [["**Abstract:**"] + [f"Text {i}" for i in range(1, n)] for n in n_calls]


class Steady:
    def sample(self, prompts, n_calls, settings):
        return [[f"{len(p)} and {i}" for i in range(n)] for p, n in zip(prompts, n_calls)]


def test_generation_rounds(spark, tmp_path):
    seeds = spark.createDataFrame([("1", "t", 2015, "abs"), ("2", None, None, "x" * 40_000)], "seed_id string, seed_title string, seed_year int, seed_abstract string")
    rows = {r.seed_id: r for r in generate(seeds, Stutter, "gemma_t10", str(tmp_path / "r"), n=4, max_rounds=3).collect()}
    assert rows["1"].predictions == ["Text 1", "Text 2", "Text 3"] and rows["1"].short_by == 1
    assert rows["2"].model == params.GENERATORS["gemma"].model
    assert spark.read.parquet(str(tmp_path / "r")).groupBy("round").count().count() == 3
    # A later run goes on where replies are still missing, here with a better back end and one round more.
    rows = {r.seed_id: r for r in generate(seeds, Steady, "gemma_t10", str(tmp_path / "r"), n=4, max_rounds=4).collect()}
    assert all(r.short_by == 0 and len(r.predictions) == 4 for r in rows.values())
    assert int(rows["2"].predictions[3].split()[0]) > 40_000


def test_a_run_cut_short_repeats_one_slice(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "r")
    log.mkdir()
    fails = tmp_path / "fails"
    fails.touch()

    class Fragile:
        """Notes every seed it is asked about and breaks down at one of them while the file stands."""

        def sample(self, prompts, n_calls, settings):
            for prompt in prompts:
                name = re.search("seed-[0-9]+", prompt).group()
                with open(log / name, "a") as f:
                    f.write("x")
                if name == "seed-7" and fails.exists():
                    raise RuntimeError("back end gone")
            return [[f"text {i}" for i in range(n)] for n in n_calls]

    rows = [(str(i), f"seed-{i}", 2015, "abs") for i in range(24)]
    seeds = spark.createDataFrame(rows, "seed_id string, seed_title string, seed_year int, seed_abstract string").repartition(3)
    run = lambda: generate(seeds, Fragile, "gemma_t10", out, n=2, max_rounds=2, slice_seeds=4)
    with pytest.raises(Exception, match="back end gone"):
        run()
    stored = {r.seed_id for r in spark.read.parquet(out).collect()}
    assert "7" not in stored
    fails.unlink()
    rows = run().collect()
    assert len(rows) == 24 and all(r.short_by == 0 for r in rows)
    replies = spark.read.parquet(out)
    assert replies.count() == 24 and {r.round for r in replies.collect()} == {0}
    # Stored seeds are not asked again; those repeated were in the slice that broke down (retries of its tasks included).
    assert all((log / f"seed-{i}").read_text() == "x" for i in stored)
    repeated = [p.name for p in log.iterdir() if p.read_text() != "x"]
    assert "seed-7" in repeated and len(repeated) <= 12


def test_rerank_and_labels(spark):
    goals = spark.createDataFrame([("1", "a", "cat sat mat"), ("1", "b", "dog"), ("2", "c", "x"), ("3", "d", "y")], "seed_id string, citer_id string, text string")
    gens = spark.createDataFrame([("1", ["cat sat mat", "bird"]), ("2", ["x"]), ("3", [])], "seed_id string, predictions array<string>")
    found = {r.citer_id: (r.n_gen, list(r.probs)) for r in models.rerank(goals, gens, WordOverlap).collect()}
    assert set(found) == {"a", "b", "c"} and found["a"][0] == 2 and found["a"][1][0] > 0.9 > found["a"][1][1]
    items = spark.createDataFrame([("a", "We propose X. It is trained using Y. Results show Z."), ("b", ""), ("c", "One. " * 130 + "Results show Z.")], "k string, text string")
    labels = {r.k: r.labels for r in models.label_texts(items, KeywordRoles, ["k"]).collect()}
    assert labels["a"] == ["OBJECTIVE", "METHOD", "RESULT"] and labels["b"] == [] and labels["c"] == ["BACKGROUND"] * 130 + ["RESULT"]


def test_a_broken_shard_holds_up_no_other(spark, tmp_path):
    source, dest, mark, told = tmp_path / "raw", str(tmp_path / "dest"), str(tmp_path / "mark"), str(tmp_path / "told")
    source.mkdir()
    for name, ids in {"a": [1, 2], "b": range(100, 400), "c": [5], "d": [6]}.items():
        shard(source / f"{name}.gz", [{"corpusid": i, "abstract": f"text {i * 7919 % 1009}"} for i in ids])
    whole = (source / "b.gz").read_bytes()
    (source / "b.gz").write_bytes(whole[:len(whole) // 2])
    shard(source / "d.gz", [{"corpusid": 6, "abstract": "x"}], ['{"corpusid": 7, "abstr'])
    run = lambda: ingest_with_verdicts(spark, "abstracts", str(source), dest, mark, told)
    ids = lambda: sorted(r.corpusid for r in layers.read_bucketed(spark, "abstracts", dest).collect())
    for _ in range(2):
        with pytest.raises(BrokenShards) as error:
            run()
        assert sorted(name[-4:] for name in error.value.reasons) == ["b.gz", "d.gz"]
        assert ids() == [1, 2, 5]
    assert {r.shard[-4:]: r.loaded for r in shard_verdicts(spark, told).collect()} == {"a.gz": True, "b.gz": False, "c.gz": True, "d.gz": False}
    (source / "b.gz").write_bytes(whole)
    shard(source / "d.gz", [{"corpusid": 6, "abstract": "x"}])
    shard(source / "e.gz", [{"corpusid": 8, "abstract": "y"}])
    assert run() == 302
    assert ids() == [1, 2, 5, 6, 8, *range(100, 400)]
    assert run() == 0 and shard_verdicts(spark, told).where("not loaded").isEmpty()


def test_append_new_skips_finished(spark, tmp_path):
    units = lambda n: spark.range(n).select(F.col("id").alias("k"))
    for n in (3, 5):
        append_new(units(n), ["k"], str(tmp_path / "o"), lambda todo: todo.withColumn("v", F.lit(1)), slices=2)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [0, 1, 2, 3, 4]


def test_parameters_and_command_line():
    assert params.parse_buckets("0,1,5-7") == [0, 1, 5, 6, 7]
    assert params.parse_optional_int("none") is None and params.parse_bool("Yes") and not params.parse_bool("0")
    with pytest.raises(ValueError):
        params.parse_bool("maybe")
    c = params.CONDITIONS
    assert [c[k].temperature for k in ("gemma_t10", "gemma_t05", "gemma_t15")] == [1.0, 0.5, 1.5] and c["gptoss"].temperature is None
    vs = c["gemma_t10_vs"]
    assert (vs.kind, vs.per_call, params.N_GENERATIONS // vs.per_call) == ("verbalized", 3, 17)
    assert params.sampling_for(c["gptoss_medium"])["max_tokens"] == 400 + 4096
    assert params.chat_flags("openai/GPT-OSS-20b") == {"reasoning_effort": "low"} and params.chat_flags("x/llama") == {}
    args = cli.parser().parse_args(["make-benchmark", "--corpus-root", "c", "--out", "o", "--n-seeds", "none", "--english-only", "no", "--min-citers", "3"])
    assert (args.n_seeds, args.english_only, args.min_citers, args.seed_infl_top_frac) == (None, False, 3, 0.1)


def test_report_commands(spark, tmp_path):
    citer = lambda i: {"id": i, "title": "t", "abstract": "One is. Two is.", "year": 2020, "fields": []}
    record = {"seed_id": "1", "seed_title": "x", "seed_year": 2019, "seed_abstract": "s", "seed_citationcount": 3, "n_citers_qualifying": 2, "part": 0, "citers": [citer("a"), citer("b")]}
    (tmp_path / "records.json").write_text(json.dumps(record) + "\n")
    run = lambda *a: cli.run(spark, cli.parser().parse_args([*a]))
    run("characterise", "--records", str(tmp_path / "records.json"), "--out", str(tmp_path / "c"))
    assert (tmp_path / "c" / "covariates").exists() and (tmp_path / "c" / "concentration").exists()
    spark.createDataFrame([("METHOD", "METHOD"), ("RESULT", "RESULT"), ("RESULT", "OTHER"), ("METHOD", "RESULT")], "r string, p string").write.parquet(str(tmp_path / "l"))
    found = run("agreement", "--table", str(tmp_path / "l"), "--reference", "r", "--predicted", "p")
    assert (found["n"], found["precision"], found["recall"]) == (4, pytest.approx(2 / 3), 1.0)


def test_results_follow_their_inputs(spark, tmp_path):
    import os
    write = lambda n: layers.write_once(spark, str(tmp_path / "o"), lambda: spark.range(n), inputs=(str(tmp_path / "i"),))
    layers.write_counted(spark.range(1), str(tmp_path / "i"))
    assert write(3) == 3 and write(5) == 3
    later = layers.committed_at(spark, str(tmp_path / "o")) / 1000 + 60
    os.utime(tmp_path / "i/_SUCCESS", (later, later))
    assert write(5) == 5
    assert layers.committed_at(spark, str(tmp_path / "none")) == -1


def test_side_table_compaction_skips_its_old_result(spark, tmp_path):
    row = lambda i: (i, f"id{i}", None, None, None, None)
    for name, ids in (("a", [3, 1]), ("b", [2])):
        spark.createDataFrame([row(i) for i in ids], layers.schemas.ACL_IDS).coalesce(1).write.parquet(str(tmp_path / name))
        source = next((tmp_path / name).glob("part-*.parquet"))
        (tmp_path / "side").mkdir(exist_ok=True)
        (tmp_path / "side" / f"{name}.parquet").write_bytes(source.read_bytes())
    assert layers.compact(spark, "acl_ids", str(tmp_path / "side"), str(tmp_path / "x")) == 3
    assert layers.compact(spark, "acl_ids", str(tmp_path / "side"), str(tmp_path / "y"), files=1, skip="b.parquet") == 2
    assert [r.corpusid for r in spark.read.parquet(str(tmp_path / "y")).collect()] == [1, 3]
