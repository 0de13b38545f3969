"""Whole analyses in one call: each writes its tables under one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lexical, matching, ranking, targets as T
from ..operators.models import embed_cached
from ..operators.pairs import seed_counts
from ..operators.vectors import centroid_dispersion, dot, mean_pairwise_similarity
from ..params import MODES
from ..session import materialise
from ..sources import layers, results
from . import characterise as CH, contrast, distributions as D, score


def write_tables(tables: dict[str, DataFrame], out: str, mode: str = "errorifexists", zipped: tuple[str, ...] = ()) -> None:
    for name, table in tables.items():
        layers.write_csv(table, f"{out}/{name}", gzip=name in zipped, mode=mode)


def score_report(
    rows: DataFrame, generations: DataFrame, citers: DataFrame, factory: Callable, encoder: str, cache: str, out: str,
    matches: DataFrame | None = None, n_boot: int = 1000, mode: str = "errorifexists", records: DataFrame | None = None,
) -> None:
    """Scores of every condition against both target modes, for the seeds all conditions share.

    ``rows`` are benchmark rows, ``generations`` (condition, seed_id, gen_idx, text),
    ``citers`` the corpus table with publication dates, ``matches`` reranker probabilities.
    ``records`` has (condition, seed_id) of all generation records, those without any text
    included: a seed with an empty record in one condition is still shared by all.
    """
    shared = T.common_seeds(generations if records is None else records)
    pairs = rows.join(shared, "seed_id", "left_semi").select(
        "seed_id", F.col("citer.id").alias("citer_id"), F.col("citer.year").alias("citer_year")
    )
    texts = results.unique_citers(rows).select(F.col("id").alias("citer_id"), F.col("abstract").alias("text"))
    vectors = embed_cached(texts, factory, f"{cache}/texts", encoder).select("citer_id", "vec")
    made = embed_cached(generations.join(shared, "seed_id", "left_semi"), factory, f"{cache}/generations", encoder)
    made = materialise(made.select("condition", "seed_id", F.col("gen_idx").alias("item_id"), "vec"))
    goals = None
    for target_mode in MODES:
        part = T.target_citers(pairs, target_mode).withColumn("mode", F.lit(target_mode))
        goals = part if goals is None else goals.unionByName(part)
    scores = materialise(score.pair_scores(
        goals.join(vectors, "citer_id"), made, results.publication_dates(citers), matches
    ))
    seeds = materialise(score.seed_scores(made))
    summary = materialise(score.summarise(score.with_strata(scores), n_boot=n_boot))
    write_tables({
        "per_seed": seeds, "per_pair": scores, "summary": summary,
        "sizes": score.stratum_sizes(score.with_strata(scores)), "undated": score.undated_pairs(scores),
        "conditions": score.condition_summary(seeds, n_boot),
        "recall_curve": matching.recall_gain(
            matching.recall_curve(scores, ["condition", "mode"], range(1, 52)), ["condition", "mode"]
        ),
        "best": score.best_condition(summary, "gemma"),
    }, out, mode, ("per_pair",))


def set_metrics(
    generations: DataFrame, vectors: DataFrame, seeds: DataFrame, per_seed: DataFrame,
) -> DataFrame:
    """The alternative metrics next to ``coverage`` and ``vendi`` of ``per_seed`` (system, seed_id, ...).

    ``seeds`` has (seed_id, text, seed_vec). All texts of all seeds count.
    """
    key = ["system", "seed_id"]
    texts = generations.join(seeds.select("seed_id"), "seed_id", "left_semi")
    systems = texts.select(*key).distinct()
    references = systems.join(seeds.select("seed_id", "text"), "seed_id")
    parts = [
        mean_pairwise_similarity(vectors, key).drop("n"), centroid_dispersion(vectors, key).drop("n"),
        vectors.join(seeds.select("seed_id", "seed_vec"), "seed_id").groupBy(*key).agg(
            F.avg(dot(F.col("vec"), F.col("seed_vec"))).alias("seed_sim")
        ),
        lexical.distinct_n(texts, key, 2), lexical.mean_length(texts, key),
        lexical.self_bleu(texts, key, "gen_idx"),
        lexical.rouge_l_max(texts, references, key, "gen_idx").withColumnRenamed("rouge_l", "rougeL_seed"),
    ]
    table = per_seed
    for part in parts:
        table = table.join(part, key, "left")
    return table


def contrast_report(per_seed: DataFrame, pairs: DataFrame, tau: float, out: str, mode: str = "errorifexists") -> None:
    """Correlations, system table and rankings, coverage by decile of seed similarity."""
    stored = materialise(per_seed)
    table = contrast.system_table(stored)
    write_tables({
        "correlations": contrast.correlations(stored), "systems": table, "rankings": contrast.rankings(table),
        "deciles": contrast.decile_coverage(pairs, tau),
    }, out, mode)


def characterise_report(
    rows: DataFrame, out: str, links: DataFrame | None = None, seeds: DataFrame | None = None,
    sims: DataFrame | None = None, mode: str = "errorifexists",
) -> None:
    """Covariates and all distribution tables of a benchmark; corpus and similarity parts on request.

    ``rows`` are benchmark rows; ``links`` and ``seeds`` describe the corpus the cut came
    from; ``sims`` holds rows with ``sim`` to the own and ``null_sim`` to another seed.
    """
    covariates = materialise(CH.pair_covariates(rows))
    sizes = seed_counts(rows)
    heads = rows.select(
        "seed_id", "seed_year", "seed_citationcount", F.length("seed_abstract").alias("length")
    ).dropDuplicates(["seed_id"])
    citer = rows.select(F.col("citer.year").alias("year"), F.length("citer.abstract").alias("length"), F.col("citer.fields").alias("fields"))
    tables = {
        "covariates": CH.covariate_shares(covariates), "intents": CH.top_intents(covariates),
        "horizon_buckets": covariates.groupBy("horizon_bucket").agg(F.count(F.lit(1)).alias("n")),
        "horizon_summary": ranking.summary(covariates, "horizon"),
        "citer_citations": ranking.summary(covariates, "citer_citations"),
        "citers_per_seed": ranking.summary(sizes, "n_citers"), "citers_per_seed_bins": D.log_histogram(sizes, "n_citers"),
        "seeds_per_year": D.year_bars(heads, "seed_year"), "citers_per_year": D.year_bars(citer, "year"),
        "seed_citations": D.log_histogram(heads, "seed_citationcount"), "concentration": D.concentration(sizes),
        "top_shares": D.top_shares(sizes), "horizon_bars": D.horizon_bars(covariates),
        "seed_lengths": D.length_histogram(heads, "length"), "citer_lengths": D.length_histogram(citer, "length"),
        "fields": D.field_shares(citer),
    }
    if links is not None and seeds is not None:
        years = rows.agg(F.min("seed_year").alias("lo"), F.max("seed_year").alias("hi")).first()
        per_seed = CH.citers_with_abstract(links, seeds, years.lo, years.hi)
        tables |= {
            "corpus_edges": CH.edge_counts(links), "corpus_bins": CH.citer_bins(per_seed),
            "corpus_quantiles": ranking.summary(per_seed, "n"), "corpus_fields": CH.top_fields(links),
            "corpus_venues": CH.top_venues(links),
        }
    if sims is not None:
        tables["similarity"] = CH.similarity_by_stratum(covariates.join(sims.select("seed_id", "citer_id", "sim"), ["seed_id", "citer_id"]))
    write_tables(tables, out, mode)
