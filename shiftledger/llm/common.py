"""What the operators share: tables, the shared scratch folder, and the definition of a word."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger.shared import shared_dir

#: Fixed value: what separates words.
SPACES = r"[\x20\x09-\x0D]+"

BATCH_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on a batch that goes to Python has at most `BATCH_BYTES`; set for the session, unless it is set lower.

    By default only rows and 64 MB bound it, so texts of a few kB make batches of tens of MB, on both sides and for each task.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", spark.conf.get(setting).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(setting, f"{BATCH_BYTES}b")


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows of `df`, written once as Parquet under ``spark.checkpoint.dir`` and read again.

    This cuts the lineage: a lost executor costs a reread, not a recomputation. So the shuffles that made the rows are of no
    more use, and Spark deletes them at the end of the write. Tables stay until `drop` or until the folder is
    emptied. A folder of this machine is used only by a local session that names none; a cluster must name one.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = shared_dir(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.saved_at = path
    return found


def drop(table: DataFrame) -> None:
    """Deletes the files of a table that `saved` returned and nothing reads any more."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.saved_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, use) -> Column:
    """`use(value)`, with `value` evaluated once."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def row_key(*columns: str) -> Column:
    """A 64-bit identity of a row; equal rows share it."""
    return F.xxhash64(*[F.col(c) for c in columns])
