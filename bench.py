"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local threads. Every query runs to the end of its
plan into a no-op sink: the median of BENCH_RUNS timed runs, after one warm run of the flagship query.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from karyospark.plans.catalogue import CATALOGUE
from karyospark.session import local_session

HEADLINE = [
    "a01_read_count_per_bin", "a02_gc_and_n_content", "a05_leave_one_out_proportion", "a06_sex_aware_reference",
    "flagship_bin_calls", "w01_blacklist_dilated", "w03_nearest_valid_mean", "w05_bilateral", "w06_gc_lowess",
    "w11_u01_cbs_segments", "w12_bic_segments", "j05_best_overlap_segment", "j06_read_to_region", "j07_a69_region_counts",
    "j08_point_in_segment", "j10_positions_outside_intervals", "a26_a27_segment_confusion", "a30_a31_confusion_pivot",
    "a38_bands_regions", "a46_p32_p33_aberrations", "j24_p35_o05_annotation", "j21_sample_report", "a50_position_counts",
    "a52_equal_mappability_bins", "a54_a58_expected_per_bin", "a68_segment_significance", "w10_outlier_cap",
]


def seconds(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    CATALOGUE[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "karyospark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    seconds(spark, "flagship_bin_calls", sf_dir)
    for name in HEADLINE:
        times[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(runs)), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else sf_dir}))


if __name__ == "__main__":
    main()
