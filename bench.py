"""Headline queries on one machine; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "g01_top_linked", "u01_normalize_url", "r05_redact_secrets", "r08_normalize_text", "c01_api_calls", "c09_endpoint_catalog",
    "c15_fixtures", "c19_best_route", "c20_resource_state", "c23_path_templates", "e01_dom_nodes", "e03_dominant_groups",
    "e08_relation_edges", "e12_ranked_tokens", "e15_type_scale", "i07_top_behaviors", "p01_politeness", "q03_run_manifest",
    "v13_outcome_check", "v15_pixel_scores", "x04_tree_scores",
]


def main() -> None:
    from pagelode.plans import registry
    from pagelode.session import local_session
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    # Start the workers and load classes before the clock runs.
    spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()
    queries["g01_top_linked"](spark, sf).collect()
    spent = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
                      "sf": os.path.basename(sf.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
