"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marlstone.plans import registry  # noqa: E402
from marlstone.session import local_session  # noqa: E402

HEADLINE = [
    "knn_topk", "union_edges", "knn_euclid", "coord_knn", "similar_items", "mips_topk", "favor_recommend", "recall_at_k", "cluster_centroids", "connected_components",
    "list_page", "like_ranking", "like_counts_for", "liked_list", "recent_like_vectors", "detail_join", "daily_pick", "base_tags", "bipartite_edges", "nested_sources", "name_search",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, partitions=int(cores) if cores.isdigit() else 8, memory="16g")
    registry.QUERIES["base_tags"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start of the JVM and first compilation
    times = {}
    for name in HEADLINE:
        if name in registry.QUERIES:
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
