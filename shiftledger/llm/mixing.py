"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement.

Each document draws an exponential key scaled by its quality weight; a source takes whole epochs first and then the
documents of smallest keys until the rest of its target is filled, to the nearest document. Keys are hashes, so reruns
agree. No source is ever sorted as a whole: sums over 256 key ranges show in which range the target ends, sums over
256 finer ranges inside it where exactly, and only that last range (about 1 in 65,536 documents) is put in order.
DataFrame functions only.

Rows: a null text has size 0; a null source is a source of its own, ordered last; equal rows are sampled each for
itself; other columns are kept by `mixed` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftledger.llm.common import let, words

WEIGHTS = (3, 1, 2)
SHARE, MOST_EPOCHS = 1.5, 2
RANGES = 256


def sampling(text: Column, identity: Column) -> Column:
    """Struct of `size` (words), `weight` (quality, over 0 to 1) and `at`: the key -ln(u) / weight mapped to [0, 1)."""
    def of(w: Column) -> Column:
        n = F.size(w)
        symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]"))
        weight = (F.greatest(F.lit(0.05), F.size(F.array_distinct(w)) / F.greatest(n, F.lit(1)))
                  * F.greatest(F.lit(0.05), 1 - symbols / F.greatest(n, F.lit(1))))
        return F.struct(n.cast("long").alias("size"), weight.alias("weight"))

    digits = F.substring(F.md5(F.concat_ws(":", identity.cast("string"), F.coalesce(text, F.lit("")))), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return let(let(words(text), of), lambda s: F.struct(
        s["size"].alias("size"), s["weight"].alias("weight"), (1 - F.exp(F.log(u) / s["weight"])).alias("at")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most: int = MOST_EPOCHS) -> DataFrame:
    """`target` of each source from (source, source_size): shares by weight, stopped at `most` times the size.

    Sources in the order of size for their weight stop first; the level that the others share follows from sums.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*map(F.lit, weights))
    weighed = sizes.withColumn("w", cycle[((F.row_number().over(by_name) - 1) % len(weights)).cast("int")].cast("double"))
    order = Window.orderBy((most * F.col("source_size") / F.col("w")), F.col("source").isNull(), "source")
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    size, w = F.col("source_size"), F.col("w")
    rest = share * F.sum(size).over(all_) - most * F.coalesce(F.sum(size).over(before), F.lit(0))
    level = rest / (F.sum(w).over(all_) - F.coalesce(F.sum(w).over(before), F.lit(0.0)))
    full = F.col("level") > most * size / w
    levelled = weighed.withColumn("level", level).withColumn("place", F.row_number().over(order)).withColumn("full", full)
    common = F.min_by("level", F.when(~F.col("full"), F.col("place"))).over(all_)
    return levelled.withColumn("common", common).select(
        "source", "source_size",
        F.when(F.col("full"), most * size.cast("double")).otherwise(F.least(w * F.col("common"), most * size.cast("double"))).alias("target"))


def _edge(rows: DataFrame, bucket: Column, begin: Column) -> DataFrame:
    """For each source key: the range in which its rest ends (`cut`) and the words before it (`begin`)."""
    sums = rows.groupBy("skey", bucket.alias("b")).agg(F.sum("size").alias("n"), F.max("rest").alias("rest"), F.max(begin).alias("begin"))
    upto = Window.partitionBy("skey").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("after", F.col("begin") + F.sum("n").over(upto)).filter(F.col("after") > F.col("rest"))
    first = run.groupBy("skey").agg(F.min_by(F.struct("b", (F.col("after") - F.col("n")).alias("begin")), "b").alias("e"))
    return first.select("skey", F.col("e.b").alias("cut"), F.col("e.begin").alias("begin"))


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`rows` (id, source, size, at, ...) with `source_size`, `target` and `copies`: how often the mix holds each row.

    `plan` has a row for each source, so Spark may broadcast it by its own size check; larger ones join by shuffle,
    where a frequent source is split.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.select(key, "source_size", "target", epochs.cast("int").alias("epochs")).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    rows = rows.withColumn("skey", key).join(plan, "skey")
    coarse = F.floor(F.col("at") * RANGES).cast("int")
    fine = F.floor(F.col("at") * RANGES * RANGES).cast("int")
    first = _edge(rows, coarse, F.lit(0)).withColumnsRenamed({"cut": "cut1", "begin": "begin1"})
    rows = rows.join(first, "skey", "left")
    inside = coarse == F.col("cut1")
    second = _edge(rows.filter(inside), fine, F.col("begin1")).withColumnsRenamed({"cut": "cut2", "begin": "begin2"})
    rows = rows.join(second, "skey", "left")
    last = inside & (fine == F.col("cut2"))
    picked = F.when(F.col("cut1").isNull() | (coarse < F.col("cut1")), True).when(
        inside & (F.col("cut2").isNull() | (fine < F.col("cut2"))), True).otherwise(False)
    ordered = Window.partitionBy("skey").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    exact = rows.filter(last).withColumn("upto", F.col("begin2") + F.sum("size").over(ordered)).withColumn(
        "picked", F.col("upto") - F.col("size") / 2 <= F.col("rest")).drop("upto")
    others = rows.filter(~F.coalesce(last, F.lit(False))).withColumn("picked", picked)
    return others.unionByName(exact).withColumn("copies", F.col("epochs") + F.col("picked").cast("int")).drop(
        "skey", "epochs", "rest", "cut1", "begin1", "cut2", "begin2", "picked")
