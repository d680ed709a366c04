"""Headline queries on one local Spark session; prints one JSON line.

BENCH_SF_DIR   data directory (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyloom.queries import QUERIES  # noqa: E402
from tallyloom.session import local_session  # noqa: E402

HEADLINE = [
    "grouped_sum_line_quantity",
    "redistribute_unknown_priority",
    "redistribute_by_reference_period",
    "ordered_rules_part_types",
    "plausibility_with_envelope_donors",
    "hierarchy_roll_up",
    "complete_grid_supplied_levels",
    "ordered_record_rules",
    "completeness_scalars",
    "bounded_level_calibration",
    "annual_fraction_panel",
    "fractions_with_borrowed_donors",
    "age_standardised_rates",
    "final_cube",
    "bootstrap_level_summary",
    "draw_summary_type8",
    "interval_cube_of_series",
    "poisson_trends_with_offset",
    "reassembled_after_reallocation",
    "model_difference_metrics",
    "verified_certificate_groups",
    "stochastic_rule_weights",
    "weighted_quantile_of_quantity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "tallyloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # start-up, class loading and code generation are not part of a query
    for warm in ("grouped_sum_line_quantity", "redistribute_unknown_priority"):
        QUERIES[warm].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
