"""Times the headline queries on local cores and prints one JSON line.

Each query runs once unmeasured, then once measured, from building its plan to the last row written
to a sink that discards rows. Nothing is cached between runs.
"""

from __future__ import annotations

import json
import os
import time

from flagstone.catalog import load_all
from flagstone.session import build_session
from flagstone.sources.bindings import Tables

HEADLINE = os.environ.get("BENCH_QUERIES", "").split() or [
    "assessment", "section_rollup", "gate", "company_cards", "result_upsert", "assign_flag", "materiality",
    "document_evidence", "top_passages", "debt_to_equity", "failure_streak", "page_tables", "foreign_subject",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries, tables, seconds = load_all(), Tables(spark, folder, deal=int(cpus)), {}  # the files hold one row group each
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            entries[name].run(tables).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
