"""Summarise the executed physical plan of registered queries: shuffles,
join strategies, windows, Python steps, and what reached each Parquet scan.

usage: python scripts/plan_report.py [sf_dir] [name ...]  > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerflow.plans.catalog import QUERIES  # noqa: E402
from ledgerflow.session import get_spark  # noqa: E402

HEADLINE = ["union_daily", "union_fraud", "proxy_precision_recall", "union_enriched",
            "enriched_pair_rolling", "rolling_24_day", "amount_summary", "runs_pareto_frontier"]


def summarise(plan: str) -> dict:
    exch = re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)
    return {
        "hash/range/single exchanges": "{}/{}/{}".format(
            exch.count("hashpartitioning"), exch.count("rangepartitioning"),
            exch.count("SinglePartition")),
        "reused exchanges": plan.count("ReusedExchange"),
        "broadcast hash joins": plan.count("BroadcastHashJoin"),
        "sort-merge joins": plan.count("SortMergeJoin"),
        "broadcast nested loop (1-row)": plan.count("BroadcastNestedLoopJoin"),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "python steps": plan.count("MapInPandas") + plan.count("ArrowEvalPython")
        + plan.count("BatchEvalPython"),
    }


def scans(plan: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        m = re.search(r"FileScan (\w+) \[.*?Location: \w+\([^)]*\)\[([^\]]*)\]"
                      r".*?PushedFilters: \[(.*?)\], ReadSchema: (struct<.*)$", line)
        if not m:
            continue
        fmt, loc, pushed, schema = m.groups()
        name = os.path.basename(loc.split(",")[0])
        out.append(f"`{name}` ({fmt}) pushed [{pushed}] read {schema}")
    return out


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or HEADLINE
    spark = get_spark("local[8]", shuffle_partitions=16)
    print(f"# Executed plans ({os.path.basename(sf.rstrip('/'))}, AQE final plans)\n")
    print("Generated by `scripts/plan_report.py`. Counts are taken from the final "
          "adaptive plan of the execution that ran; a reused exchange's scans count once.\n")
    for name in names:
        df = QUERIES[name](spark, sf)
        qe = df._jdf.queryExecution()
        qe.toRdd().count()  # runs this very execution, so its plan is final
        plan = qe.executedPlan().toString()
        assert "isFinalPlan=true" in plan or "AdaptiveSparkPlan" not in plan, name
        plan = plan.split("+- == Initial Plan ==")[0]
        print(f"## {name}\n")
        for k, v in summarise(plan).items():
            print(f"* {k}: {v}")
        found = scans(plan)
        print(f"* executed scans: {len(found)}")
        for s in dict.fromkeys(found):
            print(f"* scan {s}" + (f" ({found.count(s)} times)" if found.count(s) > 1 else ""))
        print()
    spark.stop()


if __name__ == "__main__":
    main()
