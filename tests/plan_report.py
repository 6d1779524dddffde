"""Write PLANS.md: physical-plan shape of every registered query.

Usage: python tests/plan_report.py [sf_dir]   (default /root/testdata/sf0.01)
Counts come from each query's physical plan as planned (AQE's initial plan):
at run time AQE may still coalesce partitions, switch a sort-merge join to a
broadcast join by measured size, or split skewed partitions.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caseflow.plans.catalog import load_all  # noqa: E402
from caseflow.session import build_session  # noqa: E402

NODES = {
    "shuffles": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobinPartitioning|Exchange SinglePartition",
    "bhj": r"BroadcastHashJoin",
    "smj": r"SortMergeJoin",
    "shj": r"ShuffledHashJoin",
    "python": r"ArrowEvalPython|MapInPandas|PythonMapInArrow|FlatMapGroupsInPandas",
    "window": r"\bWindow\b|WindowGroupLimit",
    "topn": r"TakeOrderedAndProject",
}


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(shuffle_partitions=8)
    rows = []
    for name, spec in sorted(load_all().items()):
        df = spec.build(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = {k: len(re.findall(p, plan)) for k, p in NODES.items()}
        scans = re.findall(r"ReadSchema: struct<([^\n]*)>", plan)
        widest = max((len(re.findall(r"(?:^|,)[A-Za-z_][A-Za-z0-9_]*:", s)) for s in scans), default=0)
        pushed = "yes" if re.search(r"PushedFilters: \[[^\]]+\]", plan) else "-"
        rows.append((name, counts, widest, pushed))
    out = ["# Physical plans", "",
           f"Physical plans at `{os.path.basename(sf_dir)}`, `local[8]`, as planned (AQE may still coalesce "
           "partitions, switch joins by measured size and split skew at run time). Columns: shuffle exchanges, "
           "broadcast-hash / sort-merge / shuffled-hash joins, Python stages, window operators, "
           "top-N sorts, widest scan (top-level columns read), pushed filters.", "",
           "| query | shuffles | BHJ | SMJ | SHJ | python | window | top-N | widest scan | pushed |",
           "|---|---|---|---|---|---|---|---|---|---|"]
    for name, c, w, p in rows:
        out.append(f"| {name} | {c['shuffles']} | {c['bhj']} | {c['smj']} | {c['shj']} | {c['python']} | "
                   f"{c['window']} | {c['topn']} | {w} | {p} |")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")
    print(f"wrote PLANS.md ({len(rows)} queries)")


if __name__ == "__main__":
    main(sys.argv[1:])
