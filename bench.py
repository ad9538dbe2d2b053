"""Seconds per headline query at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Each query runs BENCH_RUNS times into a sink that discards the rows; the best run counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kinefuse.storage import build_session  # noqa: E402
from kinefuse.workloads import QUERIES  # noqa: E402

HEADLINE = (
    "kinematics_per_file",
    "harmonic_speed",
    "flow_rate",
    "safe_divide",
    "kinematic_projection",
    "resolve_columns",
    "discover_roles",
    "extract_json_array",
    "extract_json_object",
    "extract_csv",
    "flatten_payload",
    "key_paths",
    "route_format",
    "lenient_decode",
    "event_time",
    "export_rounding",
    "raw_landing",
    "sensor_lookup",
    "unified_export",
    "section_unpack",
    "rename_pairs",
    "road_status",
    "road_edges",
    "toggle_association",
    "assignment_apply",
    "response_json",
    "response_fallback",
    "fuse_folders",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in names:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
        print(name, seconds[name], file=sys.stderr)
    found = re.search(r"sf([0-9.]+)", folder)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(found.group(1)) if found else None,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
