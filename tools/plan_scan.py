"""Scan the physical plans of all queries for nested-loop joins and single-partition windows."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyloom.queries import QUERIES  # noqa: E402
from tallyloom.session import local_session  # noqa: E402


def findings(plan: str) -> list[str]:
    out = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin") if k in plan]
    # a window without partition keys pulls everything into one task
    if re.search(r"Window \[.*windowspecdefinition\((specifiedwindowframe|[^,]*(ASC|DESC))", plan):
        out.append("window without partition keys")
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session(8, "plan-scan")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, q in QUERIES.items():
        plan = q.run(spark, sf)._jdf.queryExecution().executedPlan().toString()
        hits = findings(plan)
        if hits:
            bad += 1
            print(name, hits, flush=True)
    print(f"{len(QUERIES)} plans, {bad} with findings")


if __name__ == "__main__":
    main()
