"""One JSON line: seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "fire_exits_violations", "knn_corridor_edges", "proximity_pairs", "acoustic_violations", "constraint_summary", "room_features", "flatten_multirelational", "metric_fire_safety_margin",
    "metric_zone_cohesion", "metric_stair_service_radius", "components", "betweenness", "clustering_coeff", "graph_summary", "floor_audit", "dataset_stats", "wl_histogram", "induced_patterns_k2_k3", "row_packing", "generate_rooms",
]


def main() -> None:
    from graphloom.plans import registry
    from graphloom.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, 2 * int(cpus) if cpus.isdigit() else 16)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
