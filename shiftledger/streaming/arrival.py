"""Uploads as they arrive: guard, parse and validate each new file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger.operators.rules import validate
from shiftledger.sources import grid as G


def ingest_files(spark: SparkSession, path: str, out: str, policy: dict | None = None, active: list[str] | None = None,
                 name: str = G.FILE_NAME, files_per_batch: int = 1000, max_bytes: int | None = None,
                 max_cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) after all files that are now under ``path`` have been taken in.

    A micro-batch holds whole files, and lands them as lines of their splits under ``out/landed/batch=<id>``; one that is run again
    after a failure has the same id and the same files, and overwrites what it had written. What has landed and is not yet parsed is then
    parsed and validated at once, however many batches it came in: employees go to ``out/accepted/batch=<first id>``, refused files to
    ``out/rejected/batch=<first id>``, and ``out/parsed`` names the last id. After a failure before that, the same first id is
    parsed again over what was written. So no file is lost and no row is there twice. Call it again, or from a
    new session, when files have been added: ``out/checkpoint`` knows those taken in.
    """
    file = F.expr(name)
    lines = spark.readStream.option("recursiveFileLookup", "true").option("lineSep", "\n").option("maxFilesPerTrigger", files_per_batch).text(path)
    lines = lines.select(file.alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("length"), "value")

    def land(batch: DataFrame, batch_id: int) -> None:
        placed = batch.withColumn("pos", F.monotonically_increasing_id())
        placed.write.mode("overwrite").parquet(f"{out}/landed/batch={batch_id}")

    with G.listing(spark):
        query = lines.writeStream.foreachBatch(land).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()

    spark.createDataFrame([], "last bigint").write.mode("append").parquet(f"{out}/parsed")
    done = spark.read.schema("last bigint").parquet(f"{out}/parsed").agg(F.max("last")).first()[0]
    landed = spark.read.schema("file string, split bigint, length bigint, pos bigint, value string, batch bigint").parquet(f"{out}/landed")
    new = landed.filter(F.col("batch") > (-1 if done is None else done))
    first, last = new.agg(F.min("batch"), F.max("batch")).first()
    if first is not None:
        # A name that comes again in another batch is another file.
        of_batch = new.withColumn("file", F.concat(F.col("batch").cast("string"), F.lit("/"), F.col("file"))).drop("batch")
        accepted, rejected = parse_batch(of_batch, max_bytes, max_cells)
        without = lambda c: F.expr(f"substring({c}, locate('/', {c}) + 1)")
        keep = validate(accepted.withColumn("roster_id", without("roster_id")), policy, active)
        keep.write.mode("overwrite").parquet(f"{out}/accepted/batch={first}")
        rejected.withColumn("file", without("file")).write.mode("overwrite").parquet(f"{out}/rejected/batch={first}")
        spark.createDataFrame([(last,)], "last bigint").write.mode("append").parquet(f"{out}/parsed")
    return spark.read.parquet(f"{out}/accepted"), spark.read.parquet(f"{out}/rejected")


def parse_batch(lines: DataFrame, max_bytes: int | None = None, max_cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(roster, rejects) of lines (file, split, pos, length, value) of whole files of any kind."""
    workbook = F.lower("file").rlike(r"\.xlsx?$")
    heads = lines.filter(workbook & (F.col("split") == 0)).groupBy("file").agg(
        F.min_by(F.substring(F.col("value").cast("binary"), 1, 4), "pos").alias("content"))
    files = lines.groupBy("file").agg(F.max("length").alias("length")).join(heads, "file", "left")
    files = G.guard_files(files, max_bytes)
    text = lines.filter(F.lower("file").endswith(".csv"))
    if max_bytes is not None:
        text = text.filter(F.col("length") <= max_bytes)
    grid, scanned = G.scan_roster_grid(text.drop("length"), max_cells)
    known = G.detect_meta_columns(grid, G.detect_header(grid))
    return G.parse_roster_rows(grid, known), G.rejects(files, scanned, known)
