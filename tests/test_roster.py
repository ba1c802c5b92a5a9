"""Hygiene, search, edits, paging, reports and exports on small rosters."""

import datetime

from pyspark.sql import Observation
from pyspark.sql import functions as F

from shiftledger import dims
from shiftledger.functions import roster as R
from shiftledger.operators import reports as A
from shiftledger.operators import roster as O
from shiftledger.operators.rules import validate
from shiftledger.plans import fixtures
from shiftledger.sources import sinks

SCHEMA = "roster_id int, row_idx int, name string, station string, emp_status string, id_no string, codes array<string>"


def rosters(spark, n=60, bad_from=30):
    good, bad = fixtures.PATTERNS[0].split(), fixtures.PATTERNS[8].split()
    rows = [(i // 30, i, f"n{i}", "=S" if i % 2 else "T", "Reg", str(i), bad if i >= bad_from else good) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_blank_names_are_counted(spark):
    df = spark.createDataFrame([(0, i, n, "s", "r", "1", ["A"]) for i, n in enumerate(["a", " ", "", None, "\t"])], SCHEMA)
    seen = Observation("blank")
    assert O.drop_blank_names(df, seen).count() == 1 and seen.get["dropped"] == 4


def test_missing_meta_columns(spark):
    df = spark.createDataFrame([("x", "nan", "  ")], "name string, station string, id_no string")
    r = O.fill_meta(df).first()
    assert (r.name, r.station, r.id_no, r.emp_status) == ("x", "Unspecified", "  ", "Unspecified")


def test_search_is_literal(spark):
    df = rosters(spark)
    assert O.search_roster(df, "=s").count() == 30 and O.search_roster(df, ".").count() == 0 and O.search_roster(df, " ").count() == 60
    res = validate(df)
    assert O.search_results(res, "14 CONSECUTIVE").count() == 30
    assert O.search_results(res, "false").count() == 30  # the pass flag is searched as text, too


def test_pages_are_clamped(spark):
    df = rosters(spark, 120, 120).withColumn("roster_id", F.lit(0))
    def ids(n):
        return sorted(r.row_idx for r in O.page(df, n, 50, ["roster_id"], "row_idx").collect())
    assert ids(0) == ids(1) == list(range(50)) and ids(2) == list(range(50, 100)) and ids(9) == list(range(100, 120))


def test_undated_days_stay_in_the_window(spark):
    long = O.long_form(rosters(spark, 1), "roster_id")
    period = spark.createDataFrame([(0, "A", datetime.date(2024, 5, 1)), (0, "B", None)], "roster_id int, week string, start_date date")
    days = sorted(r.day_idx for r in O.coverage_filter(long, period, None, (datetime.date(2024, 5, 2), datetime.date(2024, 5, 3))).collect())
    assert days == [1, 2, *range(7, 14)]
    assert O.coverage_filter(long, period, ["A"]).count() == 7 and O.coverage_filter(long, period, []).count() == 0


def test_day_labels(spark):
    df = spark.createDataFrame([("Mon_A", datetime.date(2024, 5, 9)), ("Sun_B", None), ("Other", None)], "k string, d date")
    got = [r[0] for r in df.select(R.day_label(F.col("k"), F.lit("Week 17"), F.col("d"))).collect()]
    assert got == ["Mon (5/6)", "Sun Week 17", "Other"]


def test_gate_opens_per_roster(spark):
    res = validate(rosters(spark))
    assert {r.roster_id for r in A.export_gate(res).collect()} == {0}
    k = {r.roster_id: r.rate for r in A.compliance_kpis(res, "roster_id").collect()}
    assert k == {0: 100, 1: 0}
    assert A.compliance_kpis(res.limit(0)).first().rate == 0


def test_half_even_percentages(spark):
    rows = spark.createDataFrame([(1, 16), (3, 16), (2, 3), (0, 0), (1, 8)], "v bigint, n bigint")
    from shiftledger.functions import numbers as N
    assert [r[0] for r in rows.select(N.percent_tenths(F.col("v"), F.col("n"))).collect()] == ["6.2%", "18.8%", "66.7%", "0.0%", "12.5%"]
    assert [r[0] for r in rows.select(N.percent_whole(F.col("v"), F.col("n"))).collect()] == ["6%", "19%", "67%", "0%", "12%"]


def test_summary_of_an_all_valid_roster(spark):
    rows = A.export_summary(validate(rosters(spark, 10, 10)), "W1", "W2", start_a="2024-05-08").collect()
    assert [r.c1 for r in rows if r.section == "violations"] == ["All employees pass every active rule."]
    assert any(r.c1 == "Mon (5/6)" for r in rows) and any(r.c1 == "Mon W2" for r in rows)


def test_headcount_total_is_the_sum_of_non_blank_cells(spark):
    pivot = A.headcount_pivot(rosters(spark)).collect()
    total = next(r for r in pivot if r["shift"] == "TOTAL")
    for d in dims.DAYS:
        assert total[d] == 60 == sum(r[d] for r in pivot if r["shift"] != "TOTAL")


def test_written_details_and_summary(spark, tmp_path):
    res = validate(rosters(spark))
    sinks.export_details(res, str(tmp_path / "d"))
    back = spark.read.option("header", True).csv(str(tmp_path / "d"))
    assert back.count() == 60 and {"Name", "Daily Hours Check", "OT Hrs Total", "Status"} <= set(back.columns)
    assert back.filter("Station = \"'=S\"").count() == 30
    sinks.export_summary_table(res, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).filter("section = 'kpi'").count() == 8
