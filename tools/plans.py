"""List plan nodes that do not scale, per registered query.

    python tools/plans.py /root/testdata/sf0.001 [name-part ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docfields.catalog.registry import all_queries  # noqa: E402
from docfields.session import build_session  # noqa: E402

SUSPECTS = ["BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "SinglePartition",
            "FlatMapGroupsInPandas", "MapInPandas"]


def main(sf_dir: str, parts: list[str]) -> None:
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in all_queries().items():
        if name.startswith("stream_") or (parts and not any(p in name for p in parts)):
            continue
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        found = [f"{s} x{plan.count(s)}" for s in SUSPECTS if s in plan]
        windows = re.findall(r"Window \[.*?\], \[(.*?)\], ", plan)
        keys = sorted({re.sub(r"#\d+L?", "", w) for w in windows})
        print(f"{name}: exchanges {plan.count('Exchange')}, {', '.join(found) or 'clean'}"
              + (f"; windows by {keys}" if keys else ""), flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
