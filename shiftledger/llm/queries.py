"""The queries of the operators, each over its whole table. `QUERIES` and `SQL` are registered by the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger.llm import chat, html_crf, html_pages, jaccard, mil, mixing, mtree, near_dedup, packing, periodic, quality_rules, resample, secrets, substrings
from shiftledger.llm.common import row_key, saved, table
from shiftledger.llm.sql import SQL  # noqa: F401  (registered together)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    f = F.col("f")
    rows = docs.select("doc_id", quality_rules.features(F.col("text")).alias("f"))
    rows = saved(rows.select("doc_id", "f", quality_rules.votes(f).alias("votes")), "votes")
    model = quality_rules.learn(rows)
    w = f["words"]
    out = rows.select("doc_id", w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), f["n_symbols"].alias("n_symbols"),
                      f["lines"]["dup"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
                      quality_rules.base_failed(w["n_words"], w["n_repeat_words"]).alias("base_failed"),
                      model.posterior(F.col("votes")).alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


@query
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = mixing.sampling(F.col("text"), F.col("doc_id"))
    rows = saved(docs.select("doc_id", "source", s.alias("s")).select("doc_id", "source", "s.size", "s.at"), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = saved(mixing.targets(sizes), "targets")
    return mixing.taken(rows, plan).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", secrets.spans("text").alias("found"))
    found = F.col("found")
    base = [r.kind for r in secrets.BASE]
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return docs.select(
        "doc_id", *map(count, base), F.sha2(listed(F.filter(found, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(found).alias("spans"))


@query
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    rows = table(spark, sf_dir, "embeddings").filter(mtree.valid(F.col("embedding"))).select("vec_id", whole.alias("embedding"))
    return mtree.top_k(rows, F.col("vec_id") % 50 == 0)


@query
def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(["user", "assistant"])]
    return chat.digests(chat.windows(rows.unionByName(spark.createDataFrame(both, "conv_id bigint, turn bigint, role string, text string"))))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"))


@query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = near_dedup.classes(docs).select("key", "class_id", "n_links")
    return docs.select("doc_id", row_key("doc_id", "text").alias("key")).join(found, "key").select("doc_id", "class_id", "n_links")


@query
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_crf.main_text("html", html_pages.default_model()).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@query
def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(part != 1).select("doc_id", F.col("quality").alias("label"))
    scored = docs.select("doc_id", (part == 1).alias("held_out"), mil.score("text", mil.learn(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic.periodic_runs(docs.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text")))


@query
def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_ids(table(spark, sf_dir, "documents").select("doc_id", "text"))
