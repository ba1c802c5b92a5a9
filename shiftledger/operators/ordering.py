"""Ordered operators that stay distributed when one group holds most of the rows.

A window over a whole group sorts that group in one task. Here every group is first cut into
deterministic buckets of the order key; a window runs per (group, bucket), and a second, small window
over one row per bucket supplies what each bucket inherits from the earlier ones. The result is the
same as that of the single window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shiftledger.shared import shared_dir

BUCKET_ROWS = 65_536


def ordinal_bucket(ordinal: Column, rows: int = BUCKET_ROWS) -> Column:
    return F.floor(ordinal / rows).cast("bigint")


def _bucketed(df: DataFrame, part: list[str], bucket: list[Column]) -> DataFrame:
    """``df`` with ``_key``: the group and its bucket. A struct is never null, so nulls in it join and group by ``=`` and
    one exchange by it serves the join with the bucket table and the window alike."""
    return df.withColumn("_key", F.struct(*[F.col(p).alias(f"p{i}") for i, p in enumerate(part)],
                                          *[b.alias(f"b{i}") for i, b in enumerate(bucket)]))


def _of_key(part: list[str], bucket: list) -> tuple[list[Column], list[Column]]:
    return [F.col(f"_key.p{i}") for i in range(len(part))], [F.col(f"_key.b{i}") for i in range(len(bucket))]


def number_rows(df: DataFrame, part: list[str], lead: list[tuple[str, str]], bucket: Column,
                order: list[str], out: str = "rn", total: str | None = None) -> DataFrame:
    """1-based row number inside ``part``, ordered by ``lead`` (low-cardinality), then ``order``.

    ``bucket`` must grow with ``order``. ``total`` also adds the size of the group. Rows are shuffled once, by (part, lead,
    bucket).
    """
    buckets = [*[F.col(c) for c, _ in lead], bucket]
    df = _bucketed(df, part, buckets)
    counts = df.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    own, steps = _of_key(part, buckets)
    by = [c.desc() if way == "desc" else c.asc() for c, way in zip(steps, [*[way for _, way in lead], "asc"])]
    group = W.partitionBy(*own) if part else W.partitionBy(F.lit(0))
    before = group.orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    sizes = [F.sum("_n").over(group).alias("_total")] if total else []
    counts = counts.select("_key", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *sizes)
    local = F.row_number().over(W.partitionBy("_key").orderBy(*order))
    joined = df.join(counts, "_key").withColumn(out, local + F.col("_before"))
    if total:
        joined = joined.withColumn(total, F.col("_total"))
    return joined.drop("_key", "_before", "_total")


def carry(df: DataFrame, part: list[str], bucket: list[Column], order: list[str], value: Column,
          out: str, inclusive: bool = False) -> DataFrame:
    """Last non-null ``value`` in the rows before each row of its ``part`` (or up to it, ``inclusive``)."""
    df = _bucketed(df, part, bucket).withColumn("_v", value)
    own, steps = _of_key(part, bucket)
    tails = df.groupBy("_key").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_tail"))
    earlier = W.partitionBy(*own).orderBy(*steps).rowsBetween(W.unboundedPreceding, -1)
    tails = tails.select("_key", F.last("_tail", ignorenulls=True).over(earlier).alias("_in"))
    inside = W.partitionBy("_key").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    last = F.last("_v", ignorenulls=True).over(inside)
    return df.join(tails, "_key").withColumn(out, F.coalesce(last, F.col("_in"))).drop("_v", "_in", "_key")


def running_sum(df: DataFrame, part: list[str], bucket: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of ``part`` up to each row; ``bucket`` must grow with ``order``, which has no ties."""
    df = _bucketed(df, part, [bucket]).withColumn("_v", value)
    own, steps = _of_key(part, [bucket])
    sums = df.groupBy("_key").agg(F.sum("_v").alias("_s"))
    earlier = W.partitionBy(*own).orderBy(*steps).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_key", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_in"))
    inside = W.partitionBy("_key").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.join(sums, "_key").withColumn(out, F.col("_in") + F.sum("_v").over(inside)).drop("_v", "_in", "_key")


def global_ranks(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """1-based place of each row of a whole table in one order, with a single exchange.

    Rows are dealt to sorted ranges and written once with their place in their range; the ranges before it are added
    from a table of one row per range. Rows that are equal in ``order`` are told apart by where they were read, so that
    many equal rows spread over several ranges; which of them comes first is not defined.
    """
    by = [*order, F.col("_tie")]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    path = shared_dir(df.sparkSession, "ranked")
    dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = df.sparkSession.read.parquet(path)
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_part", part).join(starts, "_part")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.withColumn(out, F.col("_before") + place + 1).select(*df.columns, out)
