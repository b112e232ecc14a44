"""Time the headline tasks on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridspan.operators import filter as rows  # noqa: E402
from gridspan.operators import order, region, summary  # noqa: E402
from gridspan.session import local_session, scratch_path  # noqa: E402
from gridspan.sinks import files as sinks  # noqa: E402
from gridspan.suite import QUERIES  # noqa: E402
from gridspan.suite.base import intervals, table  # noqa: E402

# The published task list, on the line items.
TASKS = {
    "describe": lambda s, sf: summary.describe(table(s, sf, "lineitem")),
    "sort_first_5": lambda s, sf: order.top(table(s, sf, "lineitem"), ["l_shipdate", "l_extendedprice:desc"], 5, ["l_orderkey"]),
    "filtered_count": lambda s, sf: summary.row_count(rows.keep_rows(table(s, sf, "lineitem"), ("l_returnflag", "==", "A"), ("l_quantity", ">=", 30))),
    "first_20": lambda s, sf: order.head(table(s, sf, "lineitem"), 20),
    "region_count": lambda s, sf: summary.row_count(region.overlap_filter(intervals(s, sf), [("A", 1000, 2000)])),
}

QUERY_NAMES = (
    "A6_value_counts_of_recent_large_lines",
    "A2_describe",
    "A3_exact_percentiles_by_counting",
    "A5_histogram",
    "A6_value_counts_of_columns",
    "A7_distinct_whole_text",
    "O1_sort",
    "O3_tail",
    "O5_sample",
    "R_7_overlap_join_per_window",
    "R_7_overlap_join_any",
    "A10_binned_signal",
    "W1_running_max_end",
    "P3_compute",
    "P5_expand_found_keys",
    "P8_samples_long",
    "P12_gt_stats",
    "A11_pileup",
    "A9_seq_stats",
    "J_b_join_bins",
    "J1_json_paths_nested",
    "R3_diff_summary",
    "R4_fingerprint_in_order",
    "S4_csv_and_K1_round_trip",
    "S25_wiggle",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cores, partitions=cores, name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    def run(build) -> None:
        build(spark, sf).write.format("noop").mode("overwrite").save()

    def export(s, sf_dir) -> None:
        sinks.write_delimited(table(s, sf_dir, "lineitem"), scratch_path(s, "export"))

    # class loading and the first compilation are not part of any task: run the tasks on the
    # smallest tables first, where there are any
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for build in TASKS.values():
            build(spark, small).write.format("noop").mode("overwrite").save()

    tasks = {name: (lambda b=build: run(b)) for name, build in TASKS.items()}
    tasks["export_tsv"] = lambda: export(spark, sf)
    tasks |= {name: (lambda b=QUERIES[name]: run(b)) for name in QUERY_NAMES}
    chosen = sys.argv[1:]
    times = {}
    for name, task in tasks.items():
        if chosen and name not in chosen:
            continue
        best = None
        for _ in range(2):
            begun = time.perf_counter()
            task()
            spent = time.perf_counter() - begun
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds, best of 2 per task", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf).removeprefix("sf")}))


if __name__ == "__main__":
    main()
