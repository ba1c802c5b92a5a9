"""Idle sessions: a gap longer than the limit ends one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.operators.ordering import carry, running_sum
from shiftledger.streaming.limits import MICROS, micros

IDLE_SECONDS = min(1800, 300)
SLOTS = 10_000  # slots of a bucket of islands


def idle_sessions(events: DataFrame, key: str, ts: str, gap: int = IDLE_SECONDS) -> DataFrame:
    """(key, session_no, start_us, end_us, events); a gap of exactly ``gap`` seconds does not end a session.

    Events of one slot as long as the gap are never apart, so a combined aggregation makes them one island without
    sorting them. Islands are chained in buckets, so that no task sees all islands of a key.
    """
    gap_us = gap * MICROS
    df = events.select(F.col(key), micros(ts).alias("us"))
    islands = df.groupBy(key, F.floor(F.col("us") / gap_us).alias("slot")).agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("events"))
    bucket = F.floor(F.col("slot") / SLOTS)
    chained = carry(islands, [key], [bucket], ["slot"], F.col("end_us"), "before")
    fresh = F.col("before").isNull() | (F.col("start_us") - F.col("before") > gap_us)
    numbered = running_sum(chained, [key], bucket, ["slot"], fresh.cast("bigint"), "session_no")
    return numbered.groupBy(key, "session_no").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("events").alias("events"))


def idle_sessions_stream(events: DataFrame, key: str, ts: str, gap: int = IDLE_SECONDS,
                         watermark: str = "10 minutes") -> DataFrame:
    """Sessions of a stream, emitted once the watermark passes their end.

    ``session_window`` merges events exactly ``gap`` apart, which is the strict comparison of the batch form.
    """
    window = F.session_window(ts, f"{gap} seconds")
    return events.withWatermark(ts, watermark).groupBy(key, window).agg(
        F.min(micros(ts)).alias("start_us"), F.max(micros(ts)).alias("end_us"), F.count(F.lit(1)).alias("events"),
    ).drop("session_window")
