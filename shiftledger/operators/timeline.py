"""Rules over an employee's calendar, across the borders of rosters.

The ten rules of a roster see its 14 days. Here the rosters of consecutive periods become one row for each employee and day,
and the rules about rolling hours, days in a row and the gap between shifts look at dates: a window of seven days may begin in one
roster and end in the next.

Rows: an employee is whatever ``employee`` names; rows without one are left out. A day that several rosters hold counts
once, with the longest of its shifts. A day without a roster is no work day and breaks a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shiftledger import dims
from shiftledger.functions.roster import lookup, strip

HITS = ["employee", "rule", "from_date", "to_date", "value", "crosses"]


def day_rows(rosters: DataFrame, employee: Column, start: Column) -> DataFrame:
    """(employee, date, period, code, hours) of rosters, of which ``start`` is the first day; ``period`` is that day."""
    days = rosters.select(employee.alias("employee"), start.cast("date").alias("period"), F.posexplode("codes").alias("d", "code"))
    days = days.filter(F.col("employee").isNotNull() & F.col("period").isNotNull())
    code = strip(F.coalesce("code", F.lit("")))
    hours = F.coalesce(lookup({c: v[0] for c, v in dims.SHIFTS.items()}, code), F.lit(0))
    shown = days.select("employee", F.date_add("period", F.col("d").cast("int")).alias("date"), F.struct(hours.alias("hours"), code.alias("code"), "period").alias("s"))
    return shown.groupBy("employee", "date").agg(F.max("s").alias("s")).select("employee", "date", "s.period", "s.code", "s.hours")


def _ordinal(date: str) -> Column:
    return F.unix_date(date)


def _stretches(days: DataFrame, hit: Column, *more: Column) -> DataFrame:
    """Consecutive dates on which ``hit`` holds, as groups: (employee, first, last) and aggregates."""
    hits = days.filter(hit)
    place = F.row_number().over(W.partitionBy("employee").orderBy("date"))
    island = (_ordinal("date") - place).alias("island")
    return hits.select("*", island).groupBy("employee", "island").agg(F.min("date").alias("first"), F.max("date").alias("last"), *more)


def rolling_hours(days: DataFrame, most: int = 60, span: int = 7) -> DataFrame:
    """Stretches of days on which the ``span`` days up to then have more than ``most`` hours.

    ``value`` is the worst sum; ``crosses`` says that each of these windows lies in several rosters, so that no roster shows it.
    """
    window = W.partitionBy("employee").orderBy(_ordinal("date")).rangeBetween(-(span - 1), 0)
    summed = days.withColumns({"sum": F.sum("hours").over(window),
                               "over": F.min("period").over(window) != F.max("period").over(window)})
    found = _stretches(summed, F.col("sum") > most, F.max("sum").alias("value"), F.min("over").alias("crosses"))
    return found.select("employee", F.lit("max_rolling_7d").alias("rule"), F.date_sub("first", span - 1).alias("from_date"),
                        F.col("last").alias("to_date"), F.col("value").cast("bigint").alias("value"), "crosses")


def work_runs(days: DataFrame, most: int = 6) -> DataFrame:
    """Runs of more than ``most`` work days; ``crosses`` says that a run lies in several rosters."""
    found = _stretches(days, F.col("hours") > 0, F.count(F.lit(1)).alias("value"), (F.min("period") != F.max("period")).alias("crosses"))
    return found.filter(F.col("value") > most).select(
        "employee", F.lit("max_consecutive").alias("rule"), F.col("first").alias("from_date"), F.col("last").alias("to_date"), "value", "crosses")


def short_gaps(days: DataFrame, least: int = dims.MIN_GAP_HOURS) -> DataFrame:
    """Shifts that start less than ``least`` hours after the one of the day before; ``crosses``: that one is in another roster."""
    ends = lookup({c: v[2] for c, v in dims.SHIFTS.items() if v[2] is not None}, F.col("code"))
    begins = lookup({c: v[1] for c, v in dims.SHIFTS.items() if v[1] is not None}, F.col("code"))
    order = W.partitionBy("employee").orderBy("date")
    before = F.lag(F.struct("date", ends.alias("ends"), "period")).over(order)
    seen = days.withColumn("before", before)
    gap = F.lit(24) + begins - F.col("before.ends")
    found = seen.filter((F.date_diff("date", "before.date") == 1) & (gap < least))
    return found.select("employee", F.lit("shift_gap").alias("rule"), F.col("before.date").alias("from_date"), F.col("date").alias("to_date"),
                        gap.cast("bigint").alias("value"), (F.col("period") != F.col("before.period")).alias("crosses"))


def timeline_violations(days: DataFrame, max_rolling: int = 60, max_days: int = 6, min_gap: int = dims.MIN_GAP_HOURS) -> DataFrame:
    """The hits of all three rules. The days of an employee are shuffled once; all windows run over that order."""
    return rolling_hours(days, max_rolling).unionByName(work_runs(days, max_days)).unionByName(short_gaps(days, min_gap)).select(*HITS)
