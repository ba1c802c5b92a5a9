"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores. Each query is built, planned and
run to a sink that discards rows, after untimed queries have started the JVM and compiled the rules. ``BENCH_QUERIES`` selects names.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger.operators.rules import validate
from shiftledger.plans.catalog import CATALOG
from shiftledger.plans.fixtures import roster_synth

HEADLINE = [
    "matrix_distribution", "validate", "compliance_kpis", "coverage_by_station", "top_violations", "headcount_pivot",
    "explode_violations", "group_violations", "rank_violations", "export_details", "policy_join", "parse_roster_rows",
    "redact_documents", "parse_log", "log_kpis", "severity_histogram", "tail", "change_feed", "attempt_rate",
    "idle_sessions", "rate_limit", "stream_validate",
]


def validate_x100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule and message for 100 periods of each employee."""
    roster = roster_synth(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    periods = roster.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(100))))
    return validate(periods)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("shiftledger-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    todo = {n: CATALOG[n][0] for n in HEADLINE} | {"validate_x100": validate_x100}
    chosen = os.environ.get("BENCH_QUERIES")
    if chosen:
        todo = {n: todo.get(n) or CATALOG[n][0] for n in chosen.split(",")}
    for warm_up in ("day_hours", "validate"):
        CATALOG[warm_up][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name, fn in todo.items():
        start = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf.group(1)) if sf else sf_dir}))


if __name__ == "__main__":
    main()
