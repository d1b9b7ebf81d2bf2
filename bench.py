"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every
query is run to the end into a sink that keeps nothing. Tables shared by several queries are staged first; that
time is reported apart as `staging` and is not part of any query's.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from basketlens.functions.staging import close
from basketlens.plans.data import open_data
from basketlens.plans.queries import REGISTRY

HEADLINE = [
    "i1_build_baskets", "i4_leave_last_out_history", "i6_user_folds", "c2_popularity_percentile", "c3_pair_counts", "c5_transition_counts",
    "c7_pair_assoc", "c8_transition_assoc", "f6_popularity_profile", "f7_relational_strength", "f8_transition_strength", "f9_idf_vectors",
    "f11_neighbor_map", "f12_feature_table", "r3_recommend_frequency", "r5_recommend_recency", "r8_recommend_temporal_knn",
    "r11_user_similarity", "r12_recommend_similarity", "r14_negative_samples", "r20_loyalty", "r26_blend_scores", "r27_temporal_edges",
    "n2_euclidean_knn", "n3_dot_top_k", "y1_similarity_users", "flagship_test_metrics", "m13_rank_auc", "g3_describe", "g5_spearman_matrix",
    "g9_bootstrap_poisson", "q8_trends", "q10_contrast_response", "q13_joint_effects", "q25_item_mechanisms", "q30_bootstrap_effects",
    "q33_oracle_users", "q34_competence_summary", "q36_complementarity",
]


SHARED = {"part": ["hist", "target", "split"],
          "brand": ["hist", "target", "split", "pair_assoc", "step_assoc", "neighbors", "preds", "scores", "panel", "features", "binned", "target_items",
                    "item_hits", "mechanisms", "regression"]}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    start = time.perf_counter()
    for item, names in SHARED.items():
        data = open_data(spark, folder, item)
        for name in names:
            getattr(data, name)
    staging = round(time.perf_counter() - start, 3)
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        REGISTRY[name].frame(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "staging": staging, "sf": sf}))
    close(spark)
    spark.stop()


if __name__ == "__main__":
    main()
