"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cueline.catalog import collect  # noqa: E402
from cueline.session import build_session  # noqa: E402

HEADLINE = [
    "session_time_budget",
    "merge_intervals",
    "subtract_intervals",
    "interval_join",
    "assign_by_max_overlap",
    "label_words",
    "asof_remap",
    "runs_of",
    "clean_segments",
    "is_garbled",
    "normalize_width",
    "repeated_lines",
    "moving_average",
    "lead_over_second",
    "calibrate_crosstalk",
    "atomic_cells",
    "plan_diff",
    "output_timeline",
    "containment_match",
    "duplicate_groups",
    "audit_books",
    "build_blocks",
    "paragraphs",
    "read_srt",
    "fail_rate_sliding",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.sql.shuffle.partitions": str(2 * int(cpus) if cpus.isdigit() else 16),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = collect()
    # one untimed query, so that the first timed one does not pay for the start
    queries["find_gaps"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
