"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then BENCH_REPEAT times; the median counts. Results go to the
noop sink, so the whole plan runs and nothing is collected. A query's time includes building it,
because some operators materialise tables while building.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from verdictframe.plans import load  # noqa: E402
from verdictframe.session import get_session  # noqa: E402

HEADLINE = (
    "confusion_matrix",
    "population_matrices",
    "paired_delta_global",
    "stratum_points",
    "cluster_stats",
    "bootstrap_ci",
    "bootstrap_blocks",
    "behavior_blocks",
    "behavior_headline_ci",
    "normalize_text",
    "behavior_label",
    "backstop_replace",
    "leakage_scan",
    "core_projection",
    "verdict_fields",
    "stratified_sample_large",
    "combine_round_robin",
    "rank_by_skewed_value",
    "balanced_assignment",
    "attach_labels",
    "usage_rollup",
    "label_summary",
    "stream_usage_window",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        f"local[{cpus}]",
        "bench",
        {
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-ckpt-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(repeat)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
