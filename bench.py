"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query runs in full:
its result is consumed by a no-op writer. ``BENCH_QUERIES`` (comma separated) limits the run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "freshness_fleet freshness_check drift_volatility volatility_class drift_stability "
    "failure_top_errors diagnose_failures type_suitability naming_coherence score_readiness "
    "readiness_fleet schema_by_table latest_snapshot snapshot_pairs content_hash hash_gate "
    "diff_columns attribute_collateral_reorder rank_rename_candidates classify_changes plan_drift "
    "detect_drift drift_events_current classify_sensitivity sensitive_columns mask_columns "
    "detect_json_columns infer_json_structure_full flatten_json column_completeness apply_shim "
    "fuzzy_field_match use_case_coverage entity_overlaps entity_overlap_pairs schema_docs "
    "route_sync_events stream_sync_log receiver_latency"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    from fleet.check import load_all
    from fleet.registry import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    load_all()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("landwatch-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed pass starts the JVM's parquet reader and the shuffle.
    QUERIES["freshness_fleet"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
