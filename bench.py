"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed in full through the ``noop`` sink (every row computed,
nothing collected) and reported as the median of ``BENCH_REPEAT`` runs
registered query.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # gold pipeline and analytics
    "resolution_by_type", "gold_build", "row_checksum", "kpi", "dashboard_bundle", "agency_pairs",
    "flag_trend_month", "tag_accuracy", "facets",
    # serving
    "list_page", "token_search", "filtered_count",
    # governance
    "masked_view", "email_chunks", "nric_leak_check",
    # state
    "apply_status_events", "steps_with_status", "case_360", "notes_feed", "chat_list",
    # text / extraction
    "flatten_elements", "chunk_fixed", "json_cut", "model_extract_stub", "truth_vs_tags",
    # search
    "knn_exact", "knn_ivf", "sop_search", "index_delta", "token_search_indexed",
    # files and streams
    "count_landing", "stream_trend", "stream_flag_trend",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    os.environ["CASEFLOW_CPUS"] = cpus

    from caseflow.plans.catalog import load_all
    from caseflow.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    reg = load_all()
    names = list(reg) if os.environ.get("BENCH_QUERIES") == "all" else [n for n in HEADLINE if n in reg]

    # warm-up: JVM, Python workers and parquet footers (not timed)
    reg["kpi"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    start = time.perf_counter()
    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)

    # most queries above read gold that was stored before; this is what building and storing it takes
    from caseflow.plans import fixtures
    from caseflow.session import checkpoint_dir
    from caseflow.sources.sinks import write_gold

    runs = []
    for k in range(repeat):
        t0 = time.perf_counter()
        write_gold(fixtures.cases(spark, sf_dir), f"{checkpoint_dir(spark)}/bench-gold-{k}")
        runs.append(time.perf_counter() - t0)
    times["gold_build_and_store"] = round(statistics.median(runs), 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus),
                      "n_queries": len(times), "repeat": repeat,
                      "wall_sec": round(time.perf_counter() - start, 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
