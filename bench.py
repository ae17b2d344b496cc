"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  Each query is executed in full through the ``noop``
sink (no collect); the figure per query is the median of $BENCH_REPEATS warm
runs after one warm-up run.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from daybook.plans.registry import QUERIES  # noqa: E402
from daybook.session import local_session  # noqa: E402

HEADLINE = [
    "revenue_91d",
    "audience_select",
    "delink_daily",
    "optout_after_mail_daily",
    "pref_ledger_daily",
    "sends_by_type",
    "opens_by_topic",
    "optout_board",
    "lifecycle_board",
]


def run(spark, key: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    dt = time.perf_counter() - t0
    # The boards persist their shared history; Spark matches cached plans by
    # content, so without this a later run would reuse an earlier run's cache.
    spark.catalog.clearCache()
    return dt


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    keys = sys.argv[1:] or HEADLINE
    # Local-size AQE targets: at sf0.1 every shuffle is a few MB, and the 64 MB
    # cluster default would coalesce each stage to one task on 8 cores.
    os.environ.setdefault("DAYBOOK_ADVISORY_BYTES", "1m")
    os.environ.setdefault("DAYBOOK_MIN_PARTITION_BYTES", "64k")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="daybook-bench")
    out = {}
    for k in keys:
        run(spark, k, sf_dir)  # warm-up: JIT, file listing, class loading
        out[k] = round(statistics.median(run(spark, k, sf_dir) for _ in range(repeats)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total_sec",
                "value": round(sum(out.values()), 3),
                "unit": "sec",
                "queries": out,
                "sf": float(m.group(1)) if m else None,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
