"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default sf0.1) and BENCH_CPUS (default all) choose data and cores. Every query is run
to the end with a no-op sink; the first run of the session is a warm-up that does not count.
"""

from __future__ import annotations

import json
import os
import sys
import time

from basketry.plans.all_queries import runnable
from basketry.session import build_session

HEADLINE = [
    "clean_price", "dedupe_merchants", "keyword_matches", "enrich_menu", "smoothed_rating", "menu_rank", "cap_menu",
    "ordered_sequence", "step_state", "pair_counts", "cond_prob_edges", "recommend_cooc", "recommend_topk",
    "popularity_pool", "negative_samples", "first_item_affinity", "next_item_affinity", "user_rfm", "fit_scalers",
    "training_set", "cart_vector", "similar_items", "time_split", "metrics_table", "policy_metrics", "auc_exact",
    "session_summary", "conditional_attach", "random_walks", "stream_attach_rate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = build_session("bench", f"local[{cpus}]", shuffle_partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    known = runnable()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
