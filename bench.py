"""Headline queries on local[$BENCH_CPUS]; prints one JSON line.

Every query is run to completion through a no-op sink, so no result is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from voxtrace.plans import registry  # noqa: E402
from voxtrace.session import drop_staged, local_session  # noqa: E402

HEADLINES = [
    "col_aggs",
    "group_aggs",
    "cond_counts",
    "histogram10",
    "otsu_slices",
    "gauss1",
    "opening",
    "components26",
    "lacuna_moments",
    "block_density",
    "seg_batch",
    "block_stats",
    "class_vote",
    "loo_accuracy",
    "trace_index",
    "tool_checks",
    "subruns",
    "score_rollup",
    "bench_agg",
    "latest_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "voxtrace-bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors
    queries = registry.all_queries()
    times: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(","):
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        drop_staged(spark)
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
