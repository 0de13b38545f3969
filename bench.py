"""Wall time of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the list below, ``all`` for everything).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from citegraph.plans.queries import QUERIES  # noqa: E402
from citegraph.session import local_session, ship  # noqa: E402

HEADLINE = [
    "edge_dedup", "influence_thresholds", "qualifying_pairs", "english_pairs", "benchmark_records", "edge_counts",
    "citers_per_seed_quantiles", "in_degree_quantiles", "duplicate_copies", "pair_covariates", "concentration_curve",
    "best_similarity", "mean_pairwise_similarity", "vendi", "recall_curve", "shuffled_targets", "spearman", "decile_coverage",
    "bootstrap_pooled", "distinct_2", "self_bleu", "rouge_l", "clean_output", "removal_counters", "score_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = ship(local_session(cpus, "citegraph-bench", **{"spark.ui.showConsoleProgress": "false"}))
    # Start-up of the JVM and of a Python worker is not part of any query.
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(8).mapInPandas(lambda frames: frames, "id long").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
