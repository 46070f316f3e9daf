"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from queries.registered import QUERIES  # noqa: E402
from tests.session import local_session  # noqa: E402

HEADLINE = [
    "clean_history",
    "rolling_history_30d",
    "rolling_history_skew_halo",
    "rolling_history_events_7d",
    "latest_state",
    "enrich_requests",
    "rank_exact_precedence",
    "ranked_messages",
    "skip_processed_repeats",
    "validate_messages",
    "history_from_messages",
    "iqr_filter",
    "robust_scale",
    "split_sizes",
    "roc_auc",
    "class_report",
    "regression_metrics",
    "train_classifier",
    "stream_rank",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    names = sys.argv[1:] or HEADLINE
    # Session start-up is not a query's time.
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    times = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
