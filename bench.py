"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data folder and the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "modelable_species",
    "w_dedup",
    "w_thin",
    "flt_suspicious",
    "ag_quality_audit",
    "m_auc",
    "m_maxtss_roc",
    "m_thresholds",
    "m_boyce_cbi",
    "m_calibration_line",
    "m_ensemble_score",
    "m_mess",
    "jn_sample_points",
    "jn_point_in_polygon",
    "jn_accessible_area",
    "jn_nearest_presence",
    "w_sample_per_species",
    "f_terrain_pipeline",
    "ag_scenario_ensemble",
    "ag_area_table",
    "ml_training_table",
    "ml_predict_one_species",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("habitspark-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from habitspark import suite

    queries = suite.load()[0]
    wanted = sys.argv[1:] or HEADLINE
    # the first job pays for starting the engine
    queries["ag_species_count"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
