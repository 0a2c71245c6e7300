"""Headline benchmark: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from tallyveil.plans import all_queries
from tallyveil.session import local_session

HEADLINE = [
    "a01_weighted_cells", "a10_shrinkage_fit", "a16_pooled_multiplier", "a22_monte_carlo_interval", "a30_person_prevalence", "a40_external_anchor_grid",
    "a46_scale_sweep", "f09_tokenise", "f10_tokenise_plain", "f28_nearest_facility", "g01_cluster_terms", "g07_combined_similarity", "io01_survey_archive",
    "io08_predicate_scan", "j05_temporal_lag", "j06_neighbour_mean", "j15_vector_neighbours", "m04_within_district_spearman", "m07_global_capture",
    "m10_metric_pack", "m18_bootstrap_macro", "ml03_boosted_trees", "ml17_binomial_thinning", "ml20_hybrid_surface", "r05_check_anchors", "st01_streaming_cells",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # The first query pays for class loading and is not a measurement.
    queries["p04_valid_responses"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
