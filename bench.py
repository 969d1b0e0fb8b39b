"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of the driver tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from checks import all_queries
from netquarry.session import build_session

HEADLINE = [
    "J02_latest_per_key",
    "A09_one_per_key",
    "A10_time_rollup",
    "A12_catalog_formulas",
    "A14_share_of_total",
    "R01_melt",
    "F04_prefix_match",
    "J10_within_angle",
    "C03_audit_parameters_detail",
    "C04_handover_share",
    "C05_audit_code_conflicts",
    "C08_audit_rtwp",
    "C10_audit_tac_lac",
    "C11_audit_missing_relations_detail",
    "C12_audit_tilt_same_sector",
    "C15_report_lte_cell",
    "C16_report_lte_site",
    "C21_kpi_query",
    "C27_flatten_parameters",
    "C28_flatten_lists",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    known["J02_latest_per_key"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        started = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline query wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
