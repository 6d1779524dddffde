"""Run every registered query against its DuckDB oracle and print a summary.

Usage: python tests/run_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caseflow.session import build_session  # noqa: E402
from caseflow.plans.catalog import load_all  # noqa: E402
from tests.oracle import compare, duck  # noqa: E402


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = set(argv[1:])
    spark = build_session(shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for name, spec in sorted(load_all().items()):
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            if spec.sql:
                r = compare(spark, name, spec.build, spec.sql, sf_dir, con)
                ok = (r["hash_match"] and r["cols_match"] and r["types_match"]
                      and r["spark_rows"] == r["duck_rows"])
            else:
                n = spec.build(spark, sf_dir).count()
                r = {"name": name, "spark_rows": n, "rows_only": True}
                ok = True
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "error": f"{type(e).__name__}: {str(e)[:400]}"}
            traceback.print_exc()
            ok = False
        r["sec"] = round(time.time() - t0, 2)
        bad += not ok
        print(("OK  " if ok else "BAD ") + json.dumps(r, default=str), flush=True)
    print(f"done: {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
