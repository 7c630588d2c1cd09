"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is run in full into Spark's no-op sink, once to warm up and then
twice; the faster of the two counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from variantframe.plans import registry
from variantframe.session import local_session

HEADLINE = (
    "prs_percentile_by_sex",
    "prs_missing_mean",
    "prs_by_chrom_pivot",
    "allele_match_best_arm",
    "score_summary_stats",
    "five_number_by_category",
    "af_log_spectrum",
    "manhattan_1mb_bins",
    "top150_per_category",
    "gene_rollup",
    "gene_pgs_matrix",
    "gene_info",
    "ranking_score",
    "range_overlap",
    "nearest_interval",
    "linkage_best_match",
    "cohort_site_icd",
    "decile_odds_ratio",
    "ivw_meta",
    "top_snp_per_gene",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(min(runs[1:]), 3)
        print(name, times[name], file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
