"""Time the headline queries; prints one JSON line.

Each query is run once to warm up and then three times; the median counts.
Results are computed in full and dropped.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from sparkprep.plans.cleaning import write_nothing
from sparkprep.queries import QUERIES
from sparkprep.session import local_session

HEADLINE = (
    "scan_csv_schema",
    "normalize_na",
    "dropna_any",
    "dropna_subset",
    "filter_equals_number",
    "fill_mean",
    "fill_median",
    "fill_median_narrowing",
    "fill_mode",
    "fill_value_string",
    "dedup_rows",
    "dedup_documents",
    "profile_columns",
    "validation_report",
    "split_clean",
    "split_error_types",
    "error_reasons",
    "unexpected_sample",
    "sink_split",
    "clean_steps",
    "clean_steps_lineitem",
    "step_report",
    "ingest_new_files",
    "lineage_edges",
    "lineage_labels",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(4):
            start = time.perf_counter()
            write_nothing(QUERIES[name](spark, folder))
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm median of 3, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
