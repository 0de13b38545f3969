"""Command line: ``python -m citegraph.cli <command> ...``, usable with spark-submit."""

from __future__ import annotations

import argparse
import json
from dataclasses import fields

from pyspark.sql import SparkSession

from .params import CutParams, parse_bool, parse_buckets, parse_optional_int
from .session import ship


def _cut_arguments(parser: argparse.ArgumentParser) -> None:
    """One flag per cut parameter, typed like its default."""
    for field in fields(CutParams):
        if field.name == "seed_infl_thresholds":
            continue
        kind = parse_optional_int
        if isinstance(field.default, bool):
            kind = parse_bool
        elif isinstance(field.default, float):
            kind = float
        parser.add_argument("--" + field.name.replace("_", "-"), type=kind, default=field.default)


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="citegraph")
    commands = root.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="new raw shards into a bucketed layer")
    ingest.add_argument("kind", choices=["abstracts", "acl_ids", "citers", "papers"])
    for name in ("--source", "--dest", "--checkpoint"):
        ingest.add_argument(name, required=True)
    ingest.add_argument("--max-files", type=int)
    ingest.add_argument("--bad-lines", help="folder for malformed lines; without it the first one stops the load")
    ingest.add_argument("--verdicts", help="folder for the outcome of every shard; broken shards are left out and tried again by the next run")
    compact = commands.add_parser("compact", help="rewrite a layer sorted by its key")
    compact.add_argument("kind", choices=["abstracts", "acl_ids", "citers", "papers"])
    compact.add_argument("--source", required=True)
    compact.add_argument("--dest", required=True)
    compact.add_argument("--files", type=int)
    build = commands.add_parser("build-corpus", help="seeds, edges and citers tables")
    build.add_argument("step", choices=["seeds", "edges", "citers", "all"])
    build.add_argument("--derived-root", required=True)
    build.add_argument("--out-root", required=True)
    build.add_argument("--acl-ids")
    build.add_argument("--buckets", type=parse_buckets)
    cut = commands.add_parser("make-benchmark", help="cut the benchmark from the corpus tables")
    cut.add_argument("--corpus-root", required=True)
    cut.add_argument("--derived-root")
    cut.add_argument("--acl-ids")
    cut.add_argument("--out", required=True)
    cut.add_argument("--force", action="store_true")
    cut.add_argument("--detector", choices=["langdetect", "word-share"], help="language rule of an English-only cut")
    cut.add_argument("--seed-infl-thresholds", help="JSON file {year: [floor, cap]}")
    _cut_arguments(cut)
    describe = commands.add_parser("characterise", help="tables describing a benchmark")
    describe.add_argument("--records", required=True)
    describe.add_argument("--sims", help="Parquet rows (seed_id, citer_id, sim)")
    describe.add_argument("--out", required=True)
    contrast = commands.add_parser("contrast", help="coverage next to the other set metrics")
    contrast.add_argument("--per-seed", required=True, help="Parquet rows of one system and seed")
    contrast.add_argument("--pairs", required=True, help="Parquet rows (system, seed_id, citer_id, seed_sim, best_cos)")
    contrast.add_argument("--tau", type=float, required=True)
    contrast.add_argument("--out", required=True)
    strip = commands.add_parser("strip", help="benchmark copy without result sentences")
    strip.add_argument("--records", required=True)
    strip.add_argument("--labels", required=True)
    strip.add_argument("--min-citers", type=int, default=CutParams().min_citers)
    strip.add_argument("--out", required=True)
    agree = commands.add_parser("agreement", help="kappa, precision and recall of two label columns")
    agree.add_argument("--table", required=True, help="Parquet rows with both labels")
    agree.add_argument("--reference", required=True)
    agree.add_argument("--predicted", required=True)
    return root


def run_report(spark: SparkSession, args: argparse.Namespace):
    """The analyses that read finished tables."""
    from .operators.agreement import agreement
    from .params import REMOVED_LABELS
    from .plans import reports, strip
    from .sources import results

    if args.command == "characterise":
        sims = spark.read.parquet(args.sims) if args.sims else None
        rows = results.benchmark_rows(results.read_benchmark(spark, args.records))
        return reports.characterise_report(rows, args.out, sims=sims)
    if args.command == "contrast":
        return reports.contrast_report(spark.read.parquet(args.per_seed), spark.read.parquet(args.pairs), args.tau, args.out)
    if args.command == "strip":
        labels = results.read_citer_labels(spark, args.labels)
        return strip.strip_benchmark(results.read_benchmark(spark, args.records), labels, args.out, args.min_citers)
    return agreement(spark.read.parquet(args.table), args.reference, args.predicted, REMOVED_LABELS).first().asDict()


def run(spark: SparkSession, args: argparse.Namespace):
    from .operators import corpus
    from .operators.models import DETECTORS, language_rule
    from .plans import cut
    from .sources import layers
    from .streaming.ingest import ingest, ingest_with_verdicts

    if args.command in ("characterise", "contrast", "strip", "agreement"):
        return run_report(spark, args)
    if args.command == "ingest" and args.verdicts:
        if args.bad_lines:
            raise SystemExit("--bad-lines keeps the good lines of a shard, --verdicts leaves the whole shard out: name one")
        return ingest_with_verdicts(spark, args.kind, args.source, args.dest, args.checkpoint, args.verdicts, args.max_files or 256)
    if args.command == "ingest":
        return ingest(spark, args.kind, args.source, args.dest, args.checkpoint, args.max_files, args.bad_lines)
    if args.command == "compact":
        return layers.compact(spark, args.kind, args.source, args.dest, args.files)
    if args.command == "build-corpus":
        steps = ("seeds", "edges", "citers") if args.step == "all" else (args.step,)
        return cut.build_corpus(spark, args.derived_root, args.out_root, steps, args.acl_ids, args.buckets)
    values = {f.name: getattr(args, f.name) for f in fields(CutParams)}
    thresholds = values.pop("seed_infl_thresholds")
    params = CutParams(**values)
    if thresholds:
        text = spark.read.text(thresholds, wholetext=True).first().value
        params = CutParams(**values, seed_infl_thresholds={int(y): v for y, v in json.loads(text).items()})
    elif params.seed_infl_top_frac or params.seed_infl_cap_frac:
        if not args.derived_root:
            raise SystemExit("--derived-root is needed to resolve the thresholds")
        papers = layers.read_bucketed(spark, "papers", f"{args.derived_root}/papers")
        side = layers.read_bucketed(spark, "acl_ids", args.acl_ids) if args.acl_ids else None
        table = corpus.influence_thresholds(
            corpus.id_source(papers, side), papers, params.seed_infl_top_frac, params.seed_infl_cap_frac
        )
        params = cut.resolved(params, table)
    seeds, citers = (spark.read.parquet(f"{args.corpus_root}/{name}") for name in ("seeds", "citers"))
    edges = cut.read_edges(spark, args.corpus_root)
    rule = language_rule(DETECTORS[args.detector]) if args.detector else None
    return cut.make_benchmark(edges, seeds, citers, args.out, params, rule, mode="overwrite" if args.force else "errorifexists")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = ship(SparkSession.builder.appName(f"citegraph {args.command}").getOrCreate())
    print(json.dumps(run(spark, args), indent=1, default=str))


if __name__ == "__main__":
    main()
