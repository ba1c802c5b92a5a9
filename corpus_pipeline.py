"""A corpus pipeline from raw documents to packed sequences: STAGES in order, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger.llm import mixing, near_dedup, packing, quality_rules, secrets
from shiftledger.llm.common import row_key, saved, small_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed limits and are probably good by the votes of the rules."""
    f, votes = F.col("__f"), F.col("__votes")
    seen = docs.withColumn("__f", quality_rules.features(F.col("text")))
    model = quality_rules.learn(seen.select(quality_rules.votes(f).alias("votes")))
    judged = seen.withColumn("__votes", quality_rules.votes(f))
    failed = quality_rules.base_failed(f["words"]["n_words"], f["words"]["n_repeat_words"])
    return judged.filter(~failed & (model.posterior(votes) >= 0.5)).select(docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates; of equal rows one."""
    firsts = near_dedup.classes(docs).filter("is_first").select(F.col("key").alias("__key"))
    keyed = docs.withColumn("__key", row_key("doc_id", "text"))
    return keyed.join(firsts, "__key", "left_semi").dropDuplicates(["__key"]).select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each secret in place of its text."""
    small_batches(spark)
    masked = docs.withColumn("text", secrets.redacted("text"))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast("long"))
    return masked.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    key = row_key("doc_id", "text")
    s = mixing.sampling(F.col("text"), F.col("doc_id"))
    rows = docs.select("doc_id", "source", key.alias("key"), s.alias("s"))
    rows = saved(rows.select("doc_id", "source", "key", "s.size", "s.at"), "sizes")
    plan = saved(mixing.targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    taken = mixing.taken(rows, plan).filter("copies > 0").select(F.col("key").alias("__key"), F.col("copies").alias("__copies"))
    # Documents are distinct here; should rows repeat, each of them meets the counts of all, so these are summed once.
    taken = taken.groupBy("__key").agg(F.sum("__copies").alias("__copies"))
    once = docs.withColumn("__key", key).dropDuplicates(["__key"])
    repeated = once.join(taken, "__key").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return repeated.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good), ("near-duplicates", keep_one), ("secrets", mask_secrets), ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; the tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"stage{k}")
    return docs
