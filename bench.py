"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs twice over its whole result (``noop`` sink); the better run
counts, so that class loading and code generation do not.
"""

from __future__ import annotations

import json
import os
import time

from blankweave.plans.catalog import QUERIES
from blankweave.session import build_session

HEADLINE = (
    "detect_blanks",
    "segmentize",
    "nearest_heading",
    "merge_continuations",
    "merge_values",
    "render_documents",
    "field_context",
    "update_text",
    "add_field_at",
    "edit_table_rows",
    "expansion_plan",
    "message_changes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    memory = os.environ.get("BENCH_MEMORY", "16g")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=memory, spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "memory": memory,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
