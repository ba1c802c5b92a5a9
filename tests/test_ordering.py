"""Bucketed ordering equals one plain window, also when one group holds most rows."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shiftledger.operators.ordering import carry, global_ranks, number_rows, ordinal_bucket, running_sum


def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        group = "hot" if rng.random() < 0.6 else f"g{rng.randrange(20)}"
        rows.append((group, i, rng.randrange(3), None if rng.random() < 0.7 else rng.randrange(100)))
    return spark.createDataFrame(rows, "g string, at int, lead int, v int")


def test_number_rows(spark):
    df = skewed(spark)
    got = number_rows(df, ["g"], [("lead", "desc")], ordinal_bucket(F.col("at"), 50), ["at"], "rn", "size")
    w = W.partitionBy("g").orderBy(F.col("lead").desc(), "at")
    want = df.withColumn("rn2", F.row_number().over(w)).withColumn("size2", F.count(F.lit(1)).over(W.partitionBy("g")))
    bad = got.join(want, ["g", "at", "lead"]).filter("rn <> rn2 or size <> size2").count()
    assert bad == 0 and got.count() == 3000


def test_carry(spark):
    df = skewed(spark)
    for inclusive in (False, True):
        got = carry(df, ["g"], [ordinal_bucket(F.col("at"), 37)], ["at"], F.col("v"), "last", inclusive)
        w = W.partitionBy("g").orderBy("at").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        want = df.withColumn("last2", F.last("v", ignorenulls=True).over(w)).select("g", "at", "last2")
        assert got.join(want, ["g", "at"]).filter("not last <=> last2").count() == 0
        assert got.count() == 3000


def test_null_group_survives(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, None), ("x", 1, 7)], "g string, at int, v int")
    out = carry(df, ["g"], [ordinal_bucket(F.col("at"), 1)], ["at"], F.col("v"), "last")
    assert {(r.g, r.at): r["last"] for r in out.collect()} == {(None, 1): None, (None, 2): 5, ("x", 1): None}


def test_running_sum(spark):
    df = skewed(spark)
    got = running_sum(df, ["g"], ordinal_bucket(F.col("at"), 41), ["at"], F.coalesce("v", F.lit(0)), "total")
    w = W.partitionBy("g").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    want = df.withColumn("total2", F.sum(F.coalesce("v", F.lit(0))).over(w)).select("g", "at", "total2")
    assert got.join(want, ["g", "at"]).filter("total <> total2").count() == 0 and got.count() == 3000


def test_global_ranks_with_many_equal_rows(spark):
    df = skewed(spark).select("lead", F.when(F.col("at") % 3 == 0, 7).otherwise(F.col("at")).alias("at"))
    rows = global_ranks(df, [F.col("lead").desc(), F.col("at")], "rank").collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 3001))
    placed = sorted(rows, key=lambda r: r["rank"])
    assert [(-r["lead"], r["at"]) for r in placed] == sorted((-r["lead"], r["at"]) for r in rows)
    assert global_ranks(df.limit(0), [F.col("at")]).count() == 0
