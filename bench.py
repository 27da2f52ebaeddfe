"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores. Every query is planned and executed in full through
the no-op sink, so nothing is collected. ``cold`` is the first run of a query
in the session, ``queries`` the second.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowloom.plans.catalog import QUERIES  # noqa: E402
from flowloom.session import local_session  # noqa: E402

HEADLINE = [
    "binetflow_projection", "zeek_projection", "flow_store", "time_bounds", "tumbling_windows", "sliding_windows",
    "node_selection", "edge_table", "node_features", "graph_table", "sequences_even", "sequences_hashed",
    "split_summary", "standardised_nodes", "evaluate_overall", "evaluate_per_scenario",
    "best_threshold_per_scenario", "packet_flows", "conversations", "dataset_overview", "top_sources",
    "host_profile", "peer_churn", "neighbour_classes", "neighbourhood_sum", "robustness_sweep",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="flowloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    def run(name: str) -> float:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t, 3)

    cold = {name: run(name) for name in HEADLINE}
    warm = {name: run(name) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline queries, total wall time, second run",
        "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
