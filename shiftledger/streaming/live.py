"""Streams of log lines and of rosters."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.functions import text as X
from shiftledger.operators.logs import log_records
from shiftledger.operators.rules import validate
from shiftledger.shared import shared_dir


def live_log_severity(lines: DataFrame, width: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """Severity counts per time bin of a stream of lines; later lines than the watermark are dropped."""
    records = log_records(lines)
    events = records.select(X.parse_ts(F.col("ts")).cast("timestamp").alias("at"),
                            X.coerce_level(F.col("level")).alias("level")).filter(F.col("at").isNotNull())
    return events.withWatermark("at", watermark).groupBy(F.window("at", width), "level").agg(
        F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("bin_start"), "level", "events")


def stream_validate(rosters: DataFrame, policy: dict | None = None, active: list[str] | None = None) -> DataFrame:
    """Validate rosters as they arrive: the batch operator is narrow, so it is the streaming one too."""
    return validate(rosters, policy, active)


def run_to_table(stream: DataFrame, purpose: str) -> DataFrame:
    """Drain a stream into a parquet table in the shared folder and return that table."""
    spark = stream.sparkSession
    path = shared_dir(spark, purpose)
    query = (stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", f"{path}/checkpoint").start(f"{path}/table"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def drain_to_table(stream: DataFrame, build: Callable[[DataFrame], DataFrame], last: dict[str, Any], purpose: str) -> DataFrame:
    """As `run_to_table` of ``build(stream)`` for a stream that ends: also what is still open at its end.

    When all input is read, the same query goes on with one closing row, ``last``, whose time is after every window.
    The watermark then passes all open state, and only the row's own window stays open. Other columns are null in it.
    """
    spark, schema = stream.sparkSession, stream.schema
    closing = shared_dir(spark, f"{purpose}-closing")
    row = [F.lit(last.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields]
    rows = spark.range(1).select(*row)
    rows.limit(0).write.parquet(closing)
    result = build(stream.unionByName(spark.readStream.schema(schema).parquet(closing)))
    path = shared_dir(spark, purpose)
    for closed in (False, True):
        if closed:
            rows.write.mode("append").parquet(closing)
        query = (result.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
                 .option("checkpointLocation", f"{path}/checkpoint").start(f"{path}/table"))
        query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}/table")
