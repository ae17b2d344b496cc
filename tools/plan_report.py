"""Write PLANS.md: operator counts and scan pushdown of each headline query's executed plan.

    python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from daybook.plans.registry import QUERIES  # noqa: E402
from daybook.session import local_session  # noqa: E402

OPS = [
    "Exchange hashpartitioning",
    "Exchange SinglePartition",
    "BroadcastExchange",
    "BroadcastHashJoin",
    "SortMergeJoin",
    "BroadcastNestedLoopJoin",
    "CartesianProduct",
    "HashAggregate",
    "ObjectHashAggregate",
    "SortAggregate",
    "Window",
    "Generate",
    "InMemoryTableScan",
]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 16, app="daybook-plans")
    out = [
        "# PLANS",
        "",
        f"Executed (final adaptive) plans of the headline queries at `{sf_dir}`, `local[8]`, 16 shuffle partitions.",
        "Counts are operator occurrences in the final plan (AQE may turn a planned sort-merge join into a broadcast join at",
        "run time). For the boards, the persisted day grain appears as an `InMemoryTableScan`; its own subplan is not",
        "counted. Generated by `tools/plan_report.py`.",
        "",
        "| query | " + " | ".join(o.replace("Exchange ", "Ex ") for o in OPS) + " |",
        "| --- | " + " | ".join("---" for _ in OPS) + " |",
    ]
    scans = []
    for key in HEADLINE:
        df = QUERIES[key](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        # keep the final adaptive plan only (the string also holds the initial one)
        plan = plan.split("== Initial Plan ==")[0]
        out.append(f"| `{key}` | " + " | ".join(str(plan.count(o)) for o in OPS) + " |")
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = re.sub(r"#\d+L?", "", buf.getvalue())
        seen = set()
        for block in re.findall(r"\(\d+\) Scan parquet[^\n]*\n(.*?)\n\n", text, re.S):
            loc = re.search(r"Location: InMemoryFileIndex \[file:[^\]]*/([a-z_]+)\.parquet\]", block)
            pushed = re.search(r"PushedFilters: (\[.*?\])\n", block + "\n")
            schema = re.search(r"ReadSchema: (struct<.*?>)\s*$", block, re.M)
            row = (key, loc.group(1) if loc else "?", pushed.group(1) if pushed else "[]", schema.group(1) if schema else "")
            if row not in seen:
                seen.add(row)
                scans.append(row)
    out += ["", "## Scans (pushed filters and read schema)", "", "| query | table | pushed filters | read schema |", "| --- | --- | --- | --- |"]
    out += [f"| `{k}` | {t} | `{p}` | `{s}` |" for k, t, p, s in scans]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    open(path, "w").write("\n".join(out) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
