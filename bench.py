"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from catalog import evaluation, ingest, sessions
from clickwarden.session import build_session

QUERIES = {
    "combined_log_parse": ingest.QUERIES, "sessionize": sessions.QUERIES, "session_summary": sessions.QUERIES,
    "weak_labels": sessions.QUERIES, "session_metadata": evaluation.QUERIES, "graph_edges": sessions.QUERIES,
    "graph_nodes": sessions.QUERIES, "hop_distance": sessions.QUERIES, "prefix_features": sessions.QUERIES,
    "full_session_features": sessions.QUERIES, "heuristic_baseline": evaluation.QUERIES,
    "roc_auc": evaluation.QUERIES, "bootstrap_ci": evaluation.QUERIES, "leakage_audit": evaluation.QUERIES,
    "page_links": ingest.QUERIES,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(QUERIES)
    # start the engine and the readers before the clock
    sessions.QUERIES["session_summary"](spark, sf_dir.rsplit("/", 1)[0] + "/sf0.001").count()
    seconds = {}
    for name in names:
        started = time.time()
        QUERIES[name][name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(sf_dir.rstrip("/").rsplit("sf", 1)[-1]),
    }))


if __name__ == "__main__":
    main()
