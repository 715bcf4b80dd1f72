"""Benchmark the headline queries.

Runs each query fully (``noop`` sink: every row computed, nothing collected)
at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``
and prints one JSON line. Each query: one warm-up, then the median of
``$BENCH_REPEATS`` (default 3) timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry import get_spark  # noqa: E402
from quarry.plans import queries as Q  # noqa: E402

HEADLINE = {
    "blocks_text": Q.blocks_text,
    "anchor_hits": Q.anchor_hits,
    "rules_between": Q.rules_between,
    "rules_sheet_cell": Q.rules_sheet_cell,
    "apply_ruleset": Q.apply_ruleset,
}


def run_once(spark, fn, sf_dir) -> float:
    t = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = get_spark(f"local[{cpus}]", app="quarry-bench")
    times = {}
    for name, fn in HEADLINE.items():
        run_once(spark, fn, sf_dir)
        times[name] = round(statistics.median(run_once(spark, fn, sf_dir) for _ in range(repeats)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
