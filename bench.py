"""Headline timings: one JSON line with the warm median of each query.

``BENCH_SF_DIR`` picks the data, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the repetitions.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cellseason.plans import catalog  # noqa: E402
from cellseason.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_area_month", "flagship_training_table", "flagship_report",  # end to end
    "D2_snap_to_grid", "D4_clip_to_areas", "D5_build_grid", "J5_score_records", "F4_labels",  # clean, score, label
    "F6_decade_rain", "E17_latest_composite", "E3_stacked_cube", "E4_join_climatology", "S1_upsert",  # cube
    "G2_rain_streak", "G3_lags", "E7_training_join", "F9_median_density", "F16_column_medians",  # features
    "M1_auc", "M3_f1_threshold", "M4_quadratic_kappa", "M9_calibration", "G9_gain_lift", "N3_wilcoxon", "L3_ridge",  # models
    "F11_area_month", "P1_complete_panel", "T1_sections", "T6_chunks", "T7_keyword_index",  # outputs, panel, text
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "cellseason-bench")
    spark.sparkContext.setLogLevel("OFF")
    queries, times = catalog.all_queries(), {}
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    for name in only:
        laps = []
        for _ in range(runs + 1):  # the first lap warms up
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            laps.append(time.perf_counter() - start)
        times[name] = round(statistics.median(laps[1:] or laps), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
