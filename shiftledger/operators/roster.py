"""Row hygiene, search, views, edits and calendar filters over rosters and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger import dims
from shiftledger.functions import roster as R
from shiftledger.operators.ordering import number_rows, ordinal_bucket
from shiftledger.operators.rules import pinned

META = ["name", "station", "emp_status", "id_no"]
EDIT_SEARCH = ["name", "id_no", "station", "emp_status"]


def fill_meta(df: DataFrame) -> DataFrame:
    """Missing, null, empty or ``nan`` meta cells become ``Unspecified``; blanks stay."""
    def filled(c: str) -> Column:
        if c not in df.columns:
            return F.lit("Unspecified")
        v = F.col(c).cast("string")
        return F.when(v.isNull() | v.isin("", "nan"), "Unspecified").otherwise(v)
    return df.withColumns({c: filled(c) for c in META})


def fill_days(df: DataFrame) -> DataFrame:
    return df.withColumn("codes", R.fill_codes(F.col("codes")))


def drop_blank_names(df: DataFrame, dropped: Observation | None = None) -> DataFrame:
    """Keep rows with a name; ``dropped`` observes how many rows had none (``dropped.get["dropped"]``)."""
    named = R.strip(F.coalesce(F.col("name"), F.lit(""))) != ""
    if dropped is not None:
        df = df.observe(dropped, F.count_if(~named).alias("dropped"))
    return df.filter(named)


def row_id(df: DataFrame) -> DataFrame:
    """Fill blank ids with a stable hash of (roster_id, row_idx)."""
    made = F.sha2(F.concat_ws("-", F.col("roster_id").cast("string"), F.col("row_idx").cast("string")), 256)
    if "row_id" not in df.columns:
        return df.withColumn("row_id", made)
    given = F.col("row_id").cast("string")
    return df.withColumn("row_id", F.when(given.isNull() | (R.strip(given) == ""), made).otherwise(given))


def _contains(c: Column, q: str) -> Column:
    return F.lower(c).contains(q.strip().lower())


def search_roster(df: DataFrame, q: str) -> DataFrame:
    """Case-insensitive literal substring in name, id, station or status."""
    if not q.strip():
        return df
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(_contains(F.col(c), q), F.lit(False)) for c in EDIT_SEARCH]))


def search_results(df: DataFrame, q: str) -> DataFrame:
    """The same over every result column as text; lists are searched item by item. Row and policy keys are not results."""
    if not q.strip():
        return df
    hidden = ("sig", "matrix", "roster_id", "row_idx", "row_id")
    shown = [f for f in df.schema.fields if not f.name.startswith(("ok_", "policy_")) and f.name not in hidden]

    def text(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(F.col(f.name), "\n")
        return F.initcap(F.col(f.name).cast("string")) if isinstance(f.dataType, T.BooleanType) else F.col(
            f.name).cast("string")
    everything = F.concat_ws("\n", *[text(f) for f in shown])
    return pinned(df, df.columns).filter(_contains(everything, q))


def violations_only(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_pass"))


def week_view(df: DataFrame, view: str = "full") -> DataFrame:
    """Meta, the days of week ``A``/``B``/``full`` as columns, the matching overtime, Status."""
    first, n = {"A": (0, 7), "B": (7, 7), "full": (0, 14)}[view]
    ot = {"A": ["ot_a"], "B": ["ot_b"], "full": ["ot_a", "ot_b", "ot_total"]}[view]
    days = [F.get("codes", F.lit(i)).alias(dims.DAYS[i]) for i in range(first, first + n)]
    keys = [c for c in ("roster_id", "row_idx") if c in df.columns]
    return df.select(*keys, "station", "emp_status", "id_no", "name", *days, *ot, "Status")


def long_form(df: DataFrame, *keep: str) -> DataFrame:
    """One row per employee-day: day_idx, code (upper-cased, trimmed)."""
    return df.select(*keep, F.posexplode("codes").alias("day_idx", "code")).withColumn(
        "code", F.upper(R.strip(F.coalesce(F.col("code"), F.lit("")))))


def coverage_filter(long: DataFrame, period: DataFrame, weeks: list[str] | None = None,
                    window: tuple | None = None) -> DataFrame:
    """Keep days of the chosen weeks whose calendar date lies in ``window``.

    ``period(roster_id, week, start_date)`` dates the weeks; the start is used as given, not snapped to
    Monday. Days without a date always stay; a reversed window is swapped.
    """
    weeks = ["A", "B"] if weeks is None else weeks
    out = long.withColumn("week", F.when(F.col("day_idx") < 7, "A").otherwise("B")).filter(F.col("week").isin(*weeks))
    if window is None:
        return out
    lo, hi = min(window), max(window)
    starts = period.select("roster_id", "week", "start_date")
    day = F.expr("date_add(start_date, day_idx % 7)")
    return out.join(starts, ["roster_id", "week"], "left").withColumn("day_date", day).filter(
        F.col("day_date").isNull() | F.col("day_date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))


def merge_edits(base: DataFrame, shown_ids: DataFrame, edited: DataFrame) -> DataFrame:
    """Rows outside the edited view stay; the view is replaced by ``edited``; new rows get ids."""
    rest = base.join(shown_ids.select("row_id"), "row_id", "left_anti")
    return row_id(rest.unionByName(edited))


def page(df: DataFrame, number: int, size: int, part: list[str], ordinal: str) -> DataFrame:
    """One page of each ``part`` in ``ordinal`` order; the page number is clamped to what exists."""
    numbered = number_rows(df, part, [], ordinal_bucket(F.col(ordinal)), [ordinal], "_rn", "_size")
    pages = F.greatest(F.lit(1), F.ceil(F.col("_size") / size))
    current = F.greatest(F.lit(1), F.least(F.lit(number), pages))
    return numbered.filter(
        (F.col("_rn") > (current - 1) * size) & (F.col("_rn") <= current * size)).drop("_rn", "_size")
