"""Compliance reports over validated results: KPIs, group-bys, pivots, violations, export sections.

Every aggregate combines map-side; the flags are read instead of the messages, so no message is built
for a count. Small report tables are ordered; detail tables are left unordered for the writer.

Reports take ``by``, the columns that tell rosters apart: with ``roster_id`` each roster has its own report, as an upload has;
without it one report covers all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shiftledger import dims
from shiftledger.functions import numbers as N
from shiftledger.functions import roster as R
from shiftledger.functions.text import failed_weeks
from shiftledger.operators.ordering import number_rows, ordinal_bucket
from shiftledger.operators.roster import drop_blank_names, long_form
from shiftledger.operators.rules import REGISTRY, registered_names, validate
from shiftledger.shared import written


def _valid() -> Column:
    return F.count_if("_pass").alias("valid")


def _count(name: str = "headcount") -> Column:
    return F.count(F.lit(1)).alias(name)


def _sum(c: str, name: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)


def compliance_kpis(results: DataFrame, *by: str) -> DataFrame:
    """total, valid, invalid, truncated rate and gap; per ``by`` when given."""
    rate = N.percent_floor(F.col("valid"), F.col("total"))
    return results.groupBy(*by).agg(_count("total"), _valid()).select(
        *by, "total", "valid", (F.col("total") - F.col("valid")).alias("invalid"),
        rate.alias("rate"), (100 - rate).alias("gap"))


def overtime_summary(results: DataFrame, weeks: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    weeks = ["A", "B"] if weeks is None else weeks
    agg = results.groupBy(*by).agg(_count("employees"), _sum("ot_a", "a"), _sum("ot_b", "b"))
    a = F.col("a") if "A" in weeks else F.lit(0).cast("bigint")
    b = F.col("b") if "B" in weeks else F.lit(0).cast("bigint")
    return agg.select(
        *by, "employees", a.alias("ot_a"), b.alias("ot_b"), (a + b).alias("ot_total"),
        N.mean_tenths(a, F.col("employees")).alias("avg_ot_a"), N.mean_tenths(b, F.col("employees")).alias("avg_ot_b"),
        N.mean_tenths(a + b, F.col("employees")).alias("avg_ot"))


def _by(results: DataFrame, column: str, by: tuple[str, ...], *more: Column) -> DataFrame:
    return results.groupBy(*by, column).agg(_count(), _valid(), *more).withColumns({
        "invalid": F.col("headcount") - F.col("valid"),
        "compliance": N.percent_tenths(F.col("valid"), F.col("headcount")),
    }).orderBy(*by, F.col("headcount").desc(), F.col(column))


def matrix_distribution(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _by(results, "matrix", by)


def _with_overtime() -> Column:
    return F.concat(F.col("compliance"), F.lit(" · "), F.col("ot").cast("string"), F.lit("h OT"))


def coverage_by_station(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _by(results, "station", by, _sum("ot_total", "ot")).withColumn("compliance_ot", _with_overtime())


def status_summary(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    status = R.strip(F.coalesce(F.col("emp_status"), F.lit("")))
    status = F.when(status == "", "Unspecified").otherwise(status)
    return results.groupBy(*by, status.alias("emp_status")).agg(_count("total"), _valid(), _sum("ot_total", "ot")).select(
        *by, "emp_status", "total", "valid", (F.col("total") - F.col("valid")).alias("invalid"),
        N.percent_whole(F.col("valid"), F.col("total")).alias("pass_rate"), "ot").orderBy(*by, "emp_status")


def _active(results: DataFrame) -> list[str]:
    return [c[3:] for c in results.columns if c.startswith("ok_")]


def _rule_name(key: str) -> str:
    return REGISTRY[key][0] if key in REGISTRY else dims.RULE_NAMES.get(key, key)


def _failures(results: DataFrame) -> list[Column]:
    """Failing employees of each active rule."""
    return [F.count_if(~F.col(f"ok_{k}")).alias(f"failed_{k}") for k in _active(results)]


def _rule_rows(keys: list[str]) -> Column:
    """An array of (ord, rule, failed), from counts by `_failures`."""
    if not keys:
        return F.expr("cast(array() as array<struct<ord:int,rule:string,failed:bigint>>)")
    return F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(_rule_name(k)).alias("rule"), F.col(f"failed_{k}").alias("failed"))
                     for i, k in enumerate(keys)])


def top_violations(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Failing employees per rule, most first; ties keep registry order."""
    counts = results.groupBy(*by).agg(_count("total"), *_failures(results))
    return counts.select(*by, "total", F.inline(_rule_rows(_active(results)))).filter("failed > 0").select(
        *by, "rule", "failed", N.percent_tenths(F.col("failed"), F.col("total")).alias("rate"), "ord",
    ).orderBy(*by, F.col("failed").desc(), "ord")


def headcount_pivot(results: DataFrame, days: list[int] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Shift x day counts with a TOTAL row; blanks excluded."""
    days = list(range(14)) if days is None else days
    counts = long_form(results, *by).filter((F.col("code") != "") & F.col("day_idx").isin(*days)).groupBy(
        *by, "code", "day_idx").agg(_count("n"))
    cells = {dims.DAYS[d]: F.coalesce(F.sum(F.when(F.col("day_idx") == d, F.col("n"))), F.lit(0)) for d in days}
    sums = [c.alias(k) for k, c in cells.items()]
    if by:
        grouped = counts.groupingSets([[F.col(c) for c in (*by, "code")], [F.col(c) for c in by]], *by, "code")
    else:
        grouped = counts.rollup("code")
    grouped = grouped.agg(F.grouping("code").alias("_g"), *sums)
    shift = F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("code"))
    return grouped.orderBy(*by, "_g", R.shift_order(F.col("code")), "code").select(*by, shift.alias("shift"), *cells)


def headcount_long(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Day, shift, headcount and shift hours, in day and shift order."""
    counts = long_form(results, *by).filter("code <> ''").groupBy(*by, "day_idx", "code").agg(_count())
    return counts.orderBy(*by, "day_idx", R.shift_order(F.col("code")), "code").select(
        *by, "day_idx", R.day_key(F.col("day_idx")).alias("day"), F.col("code").alias("shift"), "headcount",
        R.shift_window_label(F.col("code")).alias("shift_hours"))


def _metrics(label_a: str, label_b: str) -> list[tuple[str, Column]]:
    """Names and texts of the summary, from n, valid, a and b."""
    n, v, a, b = F.col("n"), F.col("valid"), F.col("a"), F.col("b")

    def hours(c: Column) -> Column:
        return F.concat(c.cast("string"), F.lit("h"))
    average = F.when(n == 0, "0h").otherwise(hours(N.mean_tenths(a + b, n)))
    return [
        ("Total Headcount", n.cast("string")), ("Valid Schedules", v.cast("string")),
        ("Invalid Schedules", (n - v).cast("string")), ("Compliance Rate", N.percent_tenths(v, n)),
        (f"{label_a} — Total OT Hours", hours(a)), (f"{label_b} — Total OT Hours", hours(b)),
        ("14-Day Total OT Hours", hours(a + b)), ("Average OT / Employee", average),
    ]


def summary_kpis(results: DataFrame, label_a: str = "Week A", label_b: str = "Week B", by: tuple[str, ...] = ()) -> DataFrame:
    """(ordinal, metric, value) text rows."""
    agg = results.groupBy(*by).agg(_count("n"), _valid(), _sum("ot_a", "a"), _sum("ot_b", "b"))
    return agg.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(m).alias("metric"), c.alias("value"))
        for i, (m, c) in enumerate(_metrics(label_a, label_b))])))


def export_header(results: DataFrame, period: DataFrame) -> DataFrame:
    """One header line per roster: labels with date ranges, employees, overtime.

    ``period`` holds (roster_id, week, label, start_date).
    """
    agg = results.groupBy("roster_id").agg(_count("n"), _sum("ot_total", "ot"))
    text = F.concat(F.col("label"), R.week_range(F.col("start_date")))
    labels = period.groupBy("roster_id").agg(
        F.max(F.when(F.col("week") == "A", text)).alias("a"), F.max(F.when(F.col("week") == "B", text)).alias("b"))
    return agg.join(labels, "roster_id", "left").select(
        "roster_id", F.coalesce("a", F.lit("Week A")).alias("week_a"), F.coalesce("b", F.lit("Week B")).alias("week_b"),
        F.concat(F.lit("Employees: "), F.col("n").cast("string")).alias("employees"),
        F.concat(F.lit("Total OT: "), F.col("ot").cast("string"), F.lit("h")).alias("overtime"))


def explode_violations(results: DataFrame) -> DataFrame:
    """One row per violation of each failing employee, in display order.

    The pattern shown here is coarser than the detected one: 4-3 from six rest days on, else 6-1.
    """
    failing = results.filter(~F.col("_pass"))
    record = "array<struct<type:string,details:string>>"

    def one(kind: str, details: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), details.alias("details"))
    parts = [
        F.when(F.size("_dv") > 0, F.array(one(dims.RULE_NAMES["max_day"], F.array_join("_dv", ", ")))).otherwise(
            F.array().cast(record)),
        F.transform("_gv", lambda v: one(dims.RULE_NAMES["shift_gap"], v)),
    ]
    others = [k for k in _active(results) if k not in ("max_day", "shift_gap")]
    parts.append(F.array_compact(F.array(*[
        F.when(~F.col(f"ok_{k}"), one(_rule_name(k),
                                      F.replace(F.col(f"msg_{k}"), F.lit(dims.FAIL_MARK), F.lit(""))))
        for k in others])) if others else F.array().cast(record))
    rds = F.length("sig") - F.length(F.replace(F.col("sig"), F.lit("R"), F.lit("")))
    return failing.select(
        "roster_id", "row_idx", "id_no", "name", "station", F.when(rds >= 6, "4-3").otherwise("6-1").alias("matrix"),
        F.posexplode(F.concat(*parts)).alias("ord", "v"),
    ).select("roster_id", "row_idx", "ord", "id_no", "name", "station", "matrix", "v.type", "v.details")


def violation_type_counts(violations: DataFrame, n: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct employees (id, else name) per violation type; the top ``n``."""
    who = F.coalesce(F.nullif(F.col("id_no"), F.lit("")), F.col("name"))
    order = R.lookup({name: i for i, (_, name) in enumerate(dims.RULES)}, F.col("type"))
    counts = violations.groupBy(*by, "type").agg(F.countDistinct(who).alias("employees"))
    if not by:
        return counts.orderBy(F.col("employees").desc(), order).limit(n)
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.col("employees").desc(), order))
    return counts.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def group_violations(violations: DataFrame, label_a: str = "Week A", label_b: str = "Week B") -> DataFrame:
    """One card per (roster, id, name): de-duplicated details, distinct rules in first-seen order.

    Repeated details are removed by a first, map-side combined aggregation on (employee, detail), so a key
    shared by very many rows (ids left ``Unspecified``) reaches its final group as distinct details only.
    """
    key = ["roster_id", "id_no", "name"]
    # One aggregate per level carries everything, so a ranking's counts and its rows share these shuffles.
    at = F.struct("row_idx", "ord", "station", "matrix")
    distinct = violations.groupBy(*key, "type", "details").agg(F.min(at).alias("at"))
    cards = distinct.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "type", "details"))).alias("items"))
    cards = cards.withColumn("base", F.get("items", F.lit(0))["at"])
    types = F.array_distinct(F.col("items")["type"])
    details = F.array_join(F.transform(
        "items", lambda i: F.concat(F.lit("["), i["type"], F.lit("] "), i["details"])), "  |  ")
    cards = cards.select(
        *key, F.col("base.station").alias("station"), F.col("base.matrix").alias("matrix"),
        F.col("base.row_idx").alias("row_idx"), types.alias("types"), details.alias("details"))
    structural = F.array(*[F.lit(r) for r in dims.STRUCTURAL_RULES])
    cards = cards.withColumns({
        "failed_weeks": failed_weeks(F.col("details"), F.lit(label_a), F.lit(label_b)),
        "n_violations": F.size("types"),
        "rules": F.array_join("types", ", "),
        "structural": F.size(F.array_intersect("types", structural)),
    })
    return cards.withColumns({
        "severity": F.when(F.col("structural") > 0, "invalid").otherwise("warning"),
        "search_blob": F.lower(F.concat_ws(" ", "id_no", "name", "station", "matrix", "rules", "details")),
    }).drop("types")


CARD = ["roster_id", "id_no", "name"]


def violation_cards(violations: DataFrame, label_a: str = "Week A", label_b: str = "Week B") -> DataFrame:
    """One card per (roster, id, name) without its details: one combined aggregation, whose state has a fixed size.

    For each rule it keeps where the employee first broke it; so neither the details of an employee nor those of a key shared by very
    many rows (ids left ``Unspecified``) ever meet. `card_page` adds the texts of the cards that are shown.
    """
    names = list(dict.fromkeys([*dims.RULE_NAMES.values(), *registered_names()]))
    place = F.struct("row_idx", "ord")
    firsts = [F.min(F.when(F.col("type") == n, place)).alias(f"at_{i}") for i, n in enumerate(names)]
    weeks = [F.max(F.col("details").contains(w)).alias(c) for w, c in (("Wk A", "in_a"), ("Wk B", "in_b"))]
    base = F.min(F.struct("row_idx", "ord", "station", "matrix")).alias("base")
    cards = violations.groupBy(*CARD).agg(base, *weeks, *firsts)
    found = F.array(*[F.when(F.col(f"at_{i}").isNotNull(), F.struct(F.col(f"at_{i}").alias("at"), F.lit(n).alias("type"))) for i, n in enumerate(names)])
    cards = cards.withColumn("types", F.transform(F.array_sort(F.array_compact(found)), lambda x: x["type"]))
    structural = F.size(F.array_intersect("types", F.array(*[F.lit(r) for r in dims.STRUCTURAL_RULES])))
    blamed = F.when(F.col("in_a") & ~F.col("in_b"), label_a).when(F.col("in_b") & ~F.col("in_a"), label_b)
    return cards.select(
        *CARD, "base.station", "base.matrix", "base.row_idx", F.array_join("types", ", ").alias("rules"), F.size("types").alias("n_violations"),
        structural.alias("structural"), F.when(structural > 0, "invalid").otherwise("warning").alias("severity"),
        F.coalesce(blamed, F.lit(f"{label_a} & {label_b}")).alias("failed_weeks"))


def search_cards(cards: DataFrame, violations: DataFrame, q: str) -> DataFrame:
    """Cards that have ``q`` in their fields or in one of their details; details are searched where they are, row by row."""
    q = q.strip().lower()
    if not q:
        return cards
    rows = violations.filter(F.lower(F.concat(F.lit("["), "type", F.lit("] "), "details")).contains(q)).select(*CARD).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"c.{c}").eqNullSafe(F.col(f"v.{c}")) for c in CARD])
    fields = F.lower(F.concat_ws(" ", "c.id_no", "c.name", "c.station", "c.matrix", "c.rules"))
    found = cards.alias("c").join(rows.select(*CARD, F.lit(True).alias("_hit")).alias("v"), same, "left")
    return found.filter(F.col("_hit") | fields.contains(q)).select("c.*")


def card_page(ranked: DataFrame, violations: DataFrame, number: int, size: int = 25) -> DataFrame:
    """The cards of ranks on one page of each roster, with the text of their distinct details in order."""
    shown = ranked.filter((F.col("rank") > (number - 1) * size) & (F.col("rank") <= number * size))
    same = reduce(lambda a, b: a & b, [F.col(f"v.{c}").eqNullSafe(F.col(f"s.{c}")) for c in CARD])
    rows = violations.alias("v").join(shown.select(*CARD).alias("s"), same, "left_semi")
    distinct = rows.groupBy(*CARD, "type", "details").agg(F.min(F.struct("row_idx", "ord")).alias("at"))
    items = F.array_sort(F.collect_list(F.struct("at", "type", "details")))
    text = F.array_join(F.transform(items, lambda i: F.concat(F.lit("["), i["type"], F.lit("] "), i["details"])), "  |  ")
    texts = distinct.groupBy(*CARD).agg(text.alias("details"))
    same = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in CARD])
    return shown.alias("s").join(texts.alias("t"), same).select("s.*", "t.details")


def rank_violations(cards: DataFrame) -> DataFrame:
    """Rank inside each roster: structural breaches, then number of rules, then input order.

    Cards are written once, as the counts of their buckets and the cards themselves are both read.
    """
    return number_rows(
        written(cards, "cards"), ["roster_id"], [("structural", "desc"), ("n_violations", "desc")],
        ordinal_bucket(F.col("row_idx")), ["row_idx", "id_no", "name"], "rank")


def violation_search(cards: DataFrame, q: str) -> DataFrame:
    return cards.filter(F.col("search_blob").contains(q.strip().lower())) if q.strip() else cards


def observe_metrics(results: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count employees, passes and overtime while another action runs; no extra job."""
    seen = Observation(name)
    out = results.observe(seen, _count("employees"), F.count_if("_pass").alias("passed"), _sum("ot_total", "ot_total"))
    return out, seen


def run_metrics(roster: DataFrame, path: str, policy: dict | None = None, active: list[str] | None = None) -> DataFrame:
    """Validate ``roster`` into a table at ``path``; (metric, value) of what that one run saw.

    Rows without a name are dropped and counted. All numbers are observed while the table is written, with no job of their own.
    """
    read, named, done = (Observation() for _ in range(3))
    rows = roster.observe(read, _count("rows"), F.count_if(F.size("codes") != 14).alias("odd_lengths"))
    kept = drop_blank_names(rows).observe(named, _count("employees"))
    results = validate(kept, policy, active)
    results = results.observe(done, F.count_if("_pass").alias("passed"), _sum("ot_total", "overtime_hours"),
                              *[F.count_if(~F.col(f"ok_{k}")).alias(f"failed_{k}") for k in _active(results)])
    results.write.parquet(path)
    seen = read.get | named.get | done.get
    total = max(1, seen["employees"])
    values = {"rows": seen["rows"], "blank_names": seen["rows"] - seen["employees"], "employees": seen["employees"], "odd_lengths": seen["odd_lengths"],
              "passed": seen["passed"], "pass_rate": 100 * seen["passed"] // total, "overtime_hours": seen["overtime_hours"]}
    values |= {k: v for k, v in seen.items() if k.startswith("failed_")}
    return roster.sparkSession.createDataFrame(list(values.items()), "metric string, value bigint")


def export_gate(results: DataFrame) -> DataFrame:
    """Rows of rosters whose truncated compliance rate is 100; others are locked."""
    open_ = compliance_kpis(results, "roster_id").filter("rate = 100").select("roster_id")
    return results.join(open_, "roster_id", "left_semi")


def export_summary(results: DataFrame, label_a: str = "Week A", label_b: str = "Week B",
                   start_a: str | None = None, start_b: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The summary sheet as (section, ordinal, c1..c4) text rows, one sheet for each value of ``by``.

    ``results`` is read twice: once for the counts by pattern, by station and of all rows together, as grouping sets,
    and once for the days. Ordinals are numbered over the aggregated rows, never over results.
    """
    groups = [[F.col(c) for c in (*by, *more)] for more in (["matrix"], ["station"], [])]
    counted = results.groupingSets(groups, *by, "matrix", "station").agg(
        F.grouping("matrix").alias("g_matrix"), F.grouping("station").alias("g_station"), _count("n"), _valid(),
        _sum("ot_a", "a"), _sum("ot_b", "b"), _sum("ot_total", "ot"), *_failures(results))

    def line(section: str, first: Column, second: Column, *cells: Column) -> Column:
        """A row, which comes by ``first``, then ``second``, in its section."""
        texts = [c.cast("string").alias(f"c{i}") for i, c in enumerate(cells, 1)]
        return F.struct(F.lit(section).alias("section"), first.cast("bigint").alias("o1"), second.cast("string").alias("o2"), *texts)
    blank, n = F.lit(""), F.col("n")
    share = N.percent_tenths(F.col("valid"), n)
    kpis = F.array(*[line("kpi", F.lit(i), blank, F.lit(m), c, blank, blank) for i, (m, c) in enumerate(_metrics(label_a, label_b))])
    failed = F.transform(F.filter(_rule_rows(_active(results)), lambda r: r["failed"] > 0), lambda r: line(
        "violations", -r["failed"], F.lpad(r["ord"].cast("string"), 3, "0"), r["rule"], r["failed"], N.percent_tenths(r["failed"], n), blank))
    clean = F.array(line("violations", F.lit(0), blank, F.lit("All employees pass every active rule."), blank, blank, blank))
    overall = F.concat(kpis, F.when(n == F.col("valid"), clean).otherwise(failed))
    pattern = F.array(line("matrix", -n, F.col("matrix"), F.col("matrix"), n, F.col("valid"), share))
    station = F.array(line("station", -n, F.col("station"), F.col("station"), n, F.col("valid"),
                           F.concat(share, F.lit(" · "), F.col("ot").cast("string"), F.lit("h OT"))))
    rows = counted.select(*by, F.inline(
        F.when(F.col("g_matrix") == 0, pattern).when(F.col("g_station") == 0, station).otherwise(overall)))

    first_week = F.col("day_idx") < 7
    label = F.when(first_week, label_a).otherwise(label_b)
    start = F.when(first_week, F.lit(start_a).cast("date")).otherwise(F.lit(start_b).cast("date"))
    counts = long_form(results, *by).filter("code <> ''").groupBy(*by, "day_idx", "code").agg(_count())
    code = F.col("code")
    days = counts.select(*by, F.inline(F.array(line(
        "headcount", F.col("day_idx") * 1000 + R.shift_order(code), code, R.day_label(R.day_key(F.col("day_idx")), label, start),
        code, F.col("headcount"), R.shift_window_label(code)))))
    ordinal = F.row_number().over(W.partitionBy(*by, "section").orderBy("o1", "o2"))
    return rows.unionByName(days).select(*by, "section", ordinal.cast("bigint").alias("ordinal"), "c1", "c2", "c3", "c4")
