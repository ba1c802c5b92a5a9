"""Log archives: which files count, and their lines in file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger import dims
from shiftledger.operators.ordering import number_rows

# --- fixed value: live files and <base>.YYYY-MM-DD archives -------------------------------------
ALLOWED = r"^(app\.json\.log|app\.log|audit\.log)(\.\d{4}-\d{2}-\d{2})?$"


def stream_of(file: Column) -> Column:
    return F.regexp_extract(file, r"^(app\.json|app|audit)\.log", 1)


def date_label(file: Column) -> Column:
    date = F.regexp_extract(file, r"\.log\.(\d{4}-\d{2}-\d{2})$", 1)
    return F.when(date == "", dims.LIVE_LABEL).otherwise(date)


def allowed_lines(lines: DataFrame, stream: str | None = None, date: str | None = None) -> DataFrame:
    """Keep lines of allowed files, add stream and date_label."""
    out = lines.filter(F.col("file").rlike(ALLOWED)).withColumns(
        {"stream": stream_of(F.col("file")), "date_label": date_label(F.col("file"))})
    if stream is not None:
        out = out.filter(F.col("stream") == stream)
    return out if date is None else out.filter(F.col("date_label") == date)


def scan_logs(spark: SparkSession, path: str, stream: str | None = None, date: str | None = None,
              name: str = "_metadata.file_name") -> DataFrame:
    """(path, file, line_no, value, stream, date_label) of every allowed log file under ``path``.

    Files of other names, streams or dates are not opened. Files are split like any text input, however large; a
    line's place is (start of its split, position in the split), and line numbers come from per-split counts, so no
    file is read whole by one task. Files of equal names in two folders stay apart by ``path``. ``name`` is SQL text that makes the
    name of a file from its metadata.
    """
    file = F.expr(name)
    wanted = file.rlike(ALLOWED)
    if stream is not None:
        wanted = wanted & (stream_of(file) == stream)
    if date is not None:
        wanted = wanted & (date_label(file) == date)
    raw = spark.read.option("recursiveFileLookup", "true").text(path).filter(wanted).select(
        F.col("_metadata.file_path").alias("path"), file.alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"), "value")
    labelled = raw.withColumns({"stream": stream_of(F.col("file")), "date_label": date_label(F.col("file"))})
    return number_rows(labelled, ["path"], [], F.col("_block"), ["_pos"], "line_no").drop("_block", "_pos")


def list_archives(files: DataFrame) -> DataFrame:
    """(file, stream, date_label, size) from (file, size): live files first, then streams, newest first."""
    kept = allowed_lines(files.select("file", "size"))
    live = F.col("date_label") == dims.LIVE_LABEL
    return kept.orderBy(F.when(live, 0).otherwise(1), "stream", F.col("date_label").desc())


def read_archive_list(spark: SparkSession, path: str) -> DataFrame:
    """Listing only: file contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return list_archives(files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size")))


def retained(lines: DataFrame, today: Column, days: int = 90) -> DataFrame:
    """Drop archives older than the retention window; live files stay."""
    date = F.col("date_label").try_cast("date")
    return lines.filter(date.isNull() | (date >= F.date_sub(today, days)))
