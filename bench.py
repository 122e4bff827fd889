"""Headline timings: ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores; prints one JSON line.

The derived inputs and responses are landed as files before the clock starts.  Every query
runs to completion over its whole input, with all output columns evaluated.  The first of
two runs warms the JVM; the second one counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = [
    "f14_risk_distribution",
    "f13_risk_flags",
    "f2_front_matter_fields",
    "f4_fallback_description",
    "p8_parse_failures",
    "s2_file_contents",
    "w1_first_seen",
    "w3_last_wins",
    "j1_repo_stats",
    "j3_tree_flags",
    "a6_directory_counts",
    "m1_upsert",
    "w4_new_ids",
    "m8_run_ledger",
    "o2_final_outcomes",
    "t2_update_queue",
    "a2_dashboard",
    "c6_record_builder",
    "c1_search_acquisition",
    "c4_update_check",
]


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from catalog_queries import QUERIES, landed
    from catalog_queries.views import Inputs

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelfmark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    landed.land(spark, sf_dir, f"{spark.conf.get('spark.checkpoint.dir')}/landed", int(cpus))
    seconds = {}
    for name in HEADLINES:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)

    inputs = Inputs(spark, sf_dir)
    files, text_bytes = inputs.skill_files.agg(F.count("*"), F.sum(F.octet_length("content"))).first()
    tree_rows = inputs.tree_items.count()
    rates = {
        # the reference's own estimates: 1-2 files/s and about 100 upserts/s
        "record_building_files_per_s": round(files / seconds["c6_record_builder"]),
        "upsert_rows_per_s": round(files / seconds["m1_upsert"]),
        "risk_scan_mb_per_s": round(text_bytes / 1e6 / seconds["f13_risk_flags"], 1),
        "layout_tree_rows_per_s": round(tree_rows / seconds["j3_tree_flags"]),
    }
    result = {
        "metric": "total_headline_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rates": rates,
        "sf": Path(sf_dir).name,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
