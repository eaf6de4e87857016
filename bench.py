"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from curves.operators.families import build_all
from curves.plans.registry import QUERIES, raw
from curves.sources.bars import save_frames

NAMES = ("structure_series", "all_signals", "composite_score", "seasonal_cone", "alignment_backtest")


def main() -> None:
    where, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["raw_daily_date"](spark, where).write.format("noop").mode("overwrite").save()  # so that no query carries the start of the JVM
    took = {}
    with tempfile.TemporaryDirectory() as out:
        began = time.time()
        save_frames(build_all(raw(spark, where)), out)
        took["build_all"] = time.time() - began
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        took[name] = time.time() - began
    rounded = {k: round(v, 3) for k, v in took.items()}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": rounded, "sf": Path(where).name}))


if __name__ == "__main__":
    main()
