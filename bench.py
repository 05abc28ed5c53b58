"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from flowloom.plans.registered import QUERIES
from flowloom.session import local_session

HEADLINE = [
    "label_profile",
    "row_clean_report",
    "clean_rows",
    "normalized_labels",
    "impute_medians",
    "fitted_artifacts",
    "describe_columns",
    "correlation_pairs",
    "cap_classes",
    "sample_exact",
    "first_benign_and_attacks",
    "dense_time_index",
    "window_labels",
    "window_means",
    "flow_window_edges",
    "endpoint_codes",
    "graph_readout",
    "fused_window_vectors",
    "nearest_prototype",
    "classification_report",
    "flow_roc_auc",
    "roc_curves",
    "risk_summary",
    "streamed_label_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "12g"), int(cpus) if cpus.isdigit() else 8)
    names = sys.argv[1:] or HEADLINE
    QUERIES["label_profile"].run(spark, sf_dir).collect()  # warm-up: class loading is not measured
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
