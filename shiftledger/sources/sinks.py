"""Exports. Each has a frame (what is written) and a writer; rosters become partitions or files of many rows,
never one file collected on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger import dims
from shiftledger.functions.text import csv_safe
from shiftledger.operators.reports import export_summary

# --- fixed values: header of the schedule layout ------------------------------------------------
SCHEDULE_HEADER = (["Station/Designation", "Employee Status", "ID NO.", "Operator's Name:"]
                   + dims.WEEKDAYS + ["SPACER"] + dims.WEEKDAYS)


def schedule_frame(results: DataFrame) -> DataFrame:
    """Four meta columns, seven days, a spacer, seven days; safe to open in a spreadsheet."""
    days = [F.get("codes", F.lit(i)).alias(d) for i, d in enumerate(dims.DAYS)]
    out = csv_safe(results.select("roster_id", "row_idx", "station", "emp_status", "id_no", "name", *days))
    return out.select("roster_id", "row_idx", "station", "emp_status", "id_no", "name",
                      *dims.DAYS_A, F.lit("").alias("SPACER"), *dims.DAYS_B)


def details_frame(results: DataFrame) -> DataFrame:
    """Meta, rule messages under their display names, overtime, Status; internal columns left out."""
    keys = [c[4:] for c in results.columns if c.startswith("msg_")]
    messages = [F.col(f"msg_{k}").alias(dims.RULE_NAMES.get(k, k)) for k in keys]
    return csv_safe(results.select(
        "roster_id", "row_idx", F.col("station").alias("Station"), F.col("emp_status").alias("EMP. STATUS"),
        F.col("id_no").alias("ID No."), F.col("name").alias("Name"), *messages,
        F.col("ot_a").alias("OT Hrs A"), F.col("ot_b").alias("OT Hrs B"), F.col("ot_total").alias("OT Hrs Total"),
        "Status"))


def changes_frame(feed: DataFrame) -> DataFrame:
    def cell(c: str) -> Column:
        return F.translate(F.col(c), "\t\n", "  ")
    return feed.select("file", "line_no", cell("ts").alias("timestamp"),
                       *[cell(c).alias(c) for c in ("user_id", "action", "summary", "detail")])


def schedule_headers(rosters: DataFrame, period: DataFrame | None = None) -> DataFrame:
    """(roster_id, cells): the header line of each roster; weekday cells carry their date where ``period`` has one.

    ``period`` holds (roster_id, week, start_date); any day of a week stands for it.
    """
    ids = rosters.select("roster_id").distinct()
    if period is None:
        starts = ids.withColumns({f"start_{x}": F.lit(None).cast("date") for x in "ab"})
    else:
        one = period.groupBy("roster_id").agg(*[F.max(F.when(F.col("week") == x.upper(), F.col("start_date"))).alias(f"start_{x}") for x in "ab"])
        starts = ids.join(one, "roster_id", "left")

    def week(start: str) -> list[Column]:
        cells = []
        for i, name in enumerate(dims.WEEKDAYS):
            day = F.date_add(F.date_trunc("week", start).cast("date"), i)
            dated = F.concat(F.lit(f"{name}\n"), F.month(day).cast("string"), F.lit("/"), F.day(day).cast("string"))
            cells.append(F.coalesce(dated, F.lit(name)))
        return cells
    meta = [F.lit(c) for c in SCHEDULE_HEADER[:4]]
    return starts.select("roster_id", F.array(*meta, *week("start_a"), F.lit("SPACER"), *week("start_b")).alias("cells"))


def export_schedule(results: DataFrame, path: str, period: DataFrame | None = None) -> None:
    """Schedule lines as CSV, one folder per roster; the first line is the header of the upload layout, with dates if known.

    Rows are range-partitioned by (roster, row), so a large roster is spread over several files, in order.
    """
    frame = schedule_frame(results)
    lines = frame.select(F.col("roster_id"), "row_idx", F.array(*[
        F.coalesce(F.col(c), F.lit("")) for c in frame.columns if c not in ("roster_id", "row_idx")]).alias("cells"))
    heads = schedule_headers(results, period).select("roster_id", F.lit(-1).alias("row_idx"), "cells")
    ordered = lines.unionByName(heads).repartitionByRange("roster_id", "row_idx").sortWithinPartitions("roster_id", "row_idx")
    columns = [F.get("cells", F.lit(i)).alias(f"c{i:02d}") for i in range(len(SCHEDULE_HEADER))]
    ordered.select("roster_id", *columns).write.partitionBy("roster_id").option("emptyValue", "").option("escape", '"').csv(path)


def schedule_header_line() -> str:
    return ",".join(SCHEDULE_HEADER)


def export_details(results: DataFrame, path: str) -> None:
    """Details as CSV with a header in each file, one folder per roster, in row order; a large roster has several files."""
    order = ["roster_id", "row_idx"]
    details_frame(results).repartitionByRange(*order).sortWithinPartitions(*order).drop("row_idx").write.partitionBy(
        "roster_id").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def export_summary_table(results: DataFrame, path: str, **labels: str) -> None:
    export_summary(results, **labels).write.option("header", True).csv(path)


def export_logs(records: DataFrame, path: str) -> None:
    """Redacted raw lines as text, in file and line order."""
    records.repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no").select(
        F.col("raw").alias("value")).write.text(path)


def export_changes(feed: DataFrame, path: str) -> None:
    """Newest first, tab-separated, with a header."""
    newest = [F.col("file").desc(), F.col("line_no").desc()]
    changes_frame(feed).repartitionByRange(*newest).sortWithinPartitions(*newest).drop("file", "line_no").write.option(
        "sep", "\t").option("header", True).option("quote", "").csv(path)
