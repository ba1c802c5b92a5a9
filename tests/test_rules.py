"""Golden rosters and a brute-force check of every rule on random codes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from shiftledger import dims
from shiftledger.operators import reports as A
from shiftledger.operators import rules as V
from shiftledger.operators import timeline as TI
from shiftledger.operators.rules import validate
from shiftledger.plans import fixtures

X1 = "a A A A A XX RD A A A A A AWOL RD"
GOLDEN = [
    (0, "4-3", 0, 0, {}),
    (1, "6-1", 0, 0, {}),
    (2, "5-2", 0, 0, {}),
    (3, "4-3", 24, 24, {
        "max_day": "Sun_A(8h), Sun_B(8h)", "max_week": "Wk A: 68h, Wk B: 68h exceeds max 60h",
        "max_rolling_7d": "68h in Mon_A→Sun_A (max 60h rolling 7d)",
        "max_consecutive": "6 consecutive work days in Wk A & Wk B (cross-week) (Max 5)",
        "min_rd": "Wk A: 1 RDs (need 2), Wk B: 1 RDs (need 2)"}),
    (4, "4-3", 12, 12, {"max_day": "Wed_A(8h), Thu_A(8h), Mon_B(8h), Tue_B(8h), Wed_B(8h)"}),
    (5, "6-1", 12, 12, {}),
    (6, "4-3", 24, 0, {
        "max_day": "Mon_A(8h), Tue_A(8h), Wed_A(8h), Thu_A(8h), Fri_A(8h), Sat_A(8h)",
        "max_consecutive": "6 consecutive work days in Wk A (Max 5)", "min_rd": "Wk A: 1 RDs (need 2)",
        "broken_rd": "Broken Rest Days in Wk B (Must be consecutive)",
        "shift_gap": "Mon_A→Tue_A (C→A, 0h gap, min 8h); Wed_A→Thu_A (C→A, 0h gap, min 8h); Fri_A→Sat_A (C→A, 0h gap, min 8h)"}),
    (7, "4-3", 0, 0, {"min_week": "Wk B: 36h below min 48h"}),
    (8, "6-1", 0, 0, {
        "max_consecutive": "14 consecutive work days in Wk A & Wk B (cross-week) (Max 6)",
        "min_rd": "Wk A: 0 RDs (need 1), Wk B: 0 RDs (need 1)"}),
    (9, "4-3", 0, 24, {
        "max_week": "Wk B: 72h exceeds max 60h", "max_rolling_7d": "72h in Sun_A→Sat_B (max 60h rolling 7d)",
        "min_week": "Wk A: 36h below min 48h", "max_consecutive": "6 consecutive work days in Wk B (Max 5)",
        "min_rd": "Wk B: 1 RDs (need 2)"}),
    (10, "6-1", 0, 0, {"min_week": "Wk A: 32h, Wk B: 40h below min 48h", "valid_codes": "Invalid: Sat_A(XX)"}),
]


def frame(spark, rows):
    return spark.createDataFrame(
        [(0, i, f"n{i}", "S", "R", str(i), codes) for i, codes in enumerate(rows)],
        "roster_id int, row_idx int, name string, station string, emp_status string, id_no string, codes array<string>")


@pytest.fixture(scope="module")
def golden(spark):
    rows = [p.split() for p in [*fixtures.PATTERNS, X1]]
    return {r.row_idx: r for r in V.validate(frame(spark, rows)).collect()}


@pytest.mark.parametrize("case,matrix,ot_a,ot_b,failures", GOLDEN)
def test_golden(golden, case, matrix, ot_a, ot_b, failures):
    r = golden[case]
    assert (r.matrix, r.ot_a, r.ot_b) == (matrix, ot_a, ot_b)
    failed = {k: r[f"msg_{k}"][2:] for k in dims.RULE_KEYS if r[f"msg_{k}"].startswith("❌")}
    assert failed == failures
    assert r.Status == ("Invalid" if failures else "Valid") and r._pass == (not failures)


def test_holiday_message_passes(golden):
    assert golden[7].msg_holiday_pay == "ℹ️ RH 200%: Wed_A; SPH 130%: Thu_A"
    assert golden[7].ok_holiday_pay


def test_item_lists(golden):
    assert golden[3]._dv == ["Sun_A(8h)", "Sun_B(8h)"] and golden[3]._gv == []
    assert len(golden[6]._gv) == 3


def brute(codes):
    """Independent day-by-day evaluation of the countable parts of each rule."""
    u = [c.strip().upper() for c in codes]
    hours = [dims.SHIFTS.get(c.strip(), (0, 0, 0))[0] for c in codes]
    runs = [(on, len(list(g))) for on, g in itertools.groupby(h > 0 for h in hours)]
    longest = max([n for on, n in runs if on], default=0)

    def blocks(week):
        seen = [c for c in week if c not in dims.REST_EXTRA]
        return sum(1 for is_rd, _ in itertools.groupby(c == "RD" for c in seen) if is_rd)
    gaps = 0
    for x, y in itertools.pairwise(c.strip() for c in codes):
        end, start = dims.SHIFTS.get(x, (0, None, None))[2], dims.SHIFTS.get(y, (0, None, None))[1]
        gaps += end is not None and start is not None and 24 + start - end < 8
    return {
        "a": sum(hours[:7]), "b": sum(hours[7:]), "longest": longest,
        "broken": blocks(u[:7]) > 1 or blocks(u[7:]) > 1, "gaps": gaps,
        "worst": max(sum(hours[i:i + 7]) for i in range(8)),
        "unknown": sum(1 for c in u if c not in {s.upper() for s in dims.SHIFTS}),
        "rest": [sum(c in dims.REST_EQUIVALENT for c in w) for w in (u[:7], u[7:])],
        "long": sum(c in dims.LONG_SHIFTS for c in u), "short": sum(c in dims.SHORT_SHIFTS for c in u),
    }


def test_random_rows_against_brute_force(spark):
    rng = random.Random(7)
    pool = [*dims.SHIFTS, "a", "aot", " A ", "\tRD", "leave", "rd", "XX", "os5", "Nw"]
    narrow = [["A", "RD", "C"], ["AOT", "RD", "Leave"], ["OS5", "RD", "NW", "A"], pool]
    rows = [[rng.choice(rng.choice(narrow) if i % 2 else narrow[i % 4]) for _ in range(14)] for i in range(400)]
    got = {r.row_idx: r for r in V.validate(frame(spark, rows)).join(
        V.features(frame(spark, rows)).select("row_idx", "hrs_a", "hrs_b", "roll", "rest_a", "rest_b"), "row_idx").collect()}
    for i, codes in enumerate(rows):
        want, r = brute(codes), got[i]
        assert (r.hrs_a, r.hrs_b, r.roll >> 3) == (want["a"], want["b"], want["worst"]), codes
        assert [r.rest_a, r.rest_b] == want["rest"], codes
        assert r.ok_max_week == (max(want["a"], want["b"]) <= 60)
        assert r.ok_max_rolling_7d == (want["worst"] <= 60)
        assert r.ok_max_consecutive == (want["longest"] <= (6 if r.matrix == "6-1" else 5)), codes
        assert r.ok_broken_rd == (r.matrix == "6-1" or not want["broken"]), codes
        assert len(r._gv) == want["gaps"] and r.ok_shift_gap == (want["gaps"] == 0), codes
        assert r.ok_valid_codes == (want["unknown"] == 0), codes
        if want["long"] and not want["short"]:
            assert r.matrix == "4-3"
        if want["short"] and not want["long"]:
            assert r.matrix in ("5-2", "6-1")
        for k in dims.RULE_KEYS:
            assert r[f"ok_{k}"] == ("❌" not in r[f"msg_{k}"]), (k, codes)
        assert r._pass == all(r[f"ok_{k}"] for k in dims.RULE_KEYS)


def test_floor_of_five_two(spark):
    ok44, short = "OS5 OS5 OS5 OS5 A RD RD " * 2, "OS5 OS5 OS5 OS5 RD RD RD " + "OS5 OS5 OS5 OS5 A RD RD"
    df = frame(spark, [ok44.split(), short.split()])
    assert [r.ok_min_week for r in V.validate(df).orderBy("row_idx").collect()] == [True, False]
    assert [r.ok_min_week for r in V.validate(df, {"min_week_hrs": 45}).orderBy("row_idx").collect()] == [False, False]


def test_no_work_credit(spark):
    df = frame(spark, ["A A A A A NW RD A A A A A NW RD".split()])
    assert not V.validate(df).first().ok_min_week
    assert V.validate(df, {"nw_credit_hrs": 8}).first().ok_min_week


def test_short_and_null_rows_are_filled(spark):
    r = V.validate(frame(spark, [["A", None, "A"], []])).orderBy("row_idx").collect()
    assert r[0].sig == "A_A" + "_" * 11 and r[1].sig == "_" * 14


def test_inactive_rules_have_no_column(spark):
    v = V.validate(frame(spark, [fixtures.PATTERNS[3].split()]), active=["max_week", "unknown"])
    assert [c for c in v.columns if c.startswith("msg_")] == ["msg_max_week"]
    assert v.first()._dv == [] and not v.first()._pass


def test_empty_input(spark):
    assert V.validate(frame(spark, [["A"]]).limit(0)).collect() == []


def test_policy_by_broadcast_and_by_shuffle(spark):
    df = frame(spark, [p.split() for p in fixtures.PATTERNS]).withColumn("policy_id", F.col("row_idx") % 2)
    policy = spark.createDataFrame(
        [(0, 60, 48, 60, 0, None), (1, 84, 0, 84, 0, ["max_week"])],
        "policy_id int, max_week_hrs int, min_week_hrs int, max_rolling_7d_hrs int, nw_credit_hrs int, active_rule_keys array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    found = []
    for size in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        found.append(V.validate(V.policy_join(df, policy)).orderBy("row_idx").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    small, large = found
    assert small == large
    assert small[9]._pass and small[9].msg_min_rd is None and not small[8]._pass


def test_user_rule(spark):
    V.register_rule("no_night", "No Night Shift", lambda p: V.Rule("not sig rlike '[CZ]'", "if(sig rlike '[CZ]', '❌ night', '✅')"))
    try:
        r = V.validate(frame(spark, [fixtures.PATTERNS[6].split()]), active=["no_night"]).first()
        assert r.msg_no_night == "❌ night" and not r._pass
    finally:
        V.REGISTRY.pop("no_night")


# -- user rules in Python, calendars, cards --------------------------------------------------------------------------
def test_arrow_rule_beside_native_ones(spark):
    import pandas as pd

    @F.pandas_udf("struct<passed:boolean,message:string>")
    def no_triples(codes: pd.Series, matrix: pd.Series) -> pd.DataFrame:
        found = [next((c for a, b, c in zip(x, x[1:], x[2:]) if a == b == c and c != "RD"), None) for x in codes]
        return pd.DataFrame({"passed": [f is None for f in found], "message": [f"three {f} in a row ({m})" for f, m in zip(found, matrix)]})

    rows = [("r", 1, "Ana", "S", "", "1", ["A", "B"] * 7), ("r", 2, "Bea", "S", "", "2", ["A", "A", "A"] + ["B", "RD"] * 5 + ["RD"])]
    roster = spark.createDataFrame(rows, "roster_id string, row_idx int, name string, station string, emp_status string, id_no string, codes array<string>")
    V.register_arrow_rule("no_triples", "No Triples", no_triples, "codes", "matrix")
    try:
        out = validate(roster, active=["valid_codes", "no_triples"])
        got = {r.name: (r.ok_no_triples, r.msg_no_triples, r._pass) for r in out.collect()}
        assert got == {"Ana": (True, "✅", True), "Bea": (False, "❌ three A in a row (6-1)", False)}
        tree = out._jdf.queryExecution().executedPlan().toString()
        assert tree.count("ArrowEvalPython") == 1 and "WholeStageCodegen" in out._jdf.queryExecution().toString() or "*(" in tree
        without = validate(roster, active=["valid_codes"])._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in without
        shown = A.explode_violations(validate(roster))
        assert "No Triples" in {r.type for r in shown.collect()}
        assert any("No Triples" in r.rules for r in A.violation_cards(shown).collect())
    finally:
        V.unregister_rule("no_triples")


def test_calendar_rules_see_over_the_border_of_rosters(spark):
    """Two rosters that are each in order; together they hold nine days in a row, 72 rolling hours and a gap of no hours."""
    import datetime
    first = ["RD"] * 9 + ["AOT"] * 4 + ["C"]
    second = ["A"] + ["AOT"] * 3 + ["RD"] * 10
    rows = [("7", datetime.date(2024, 1, 1), first), ("7", datetime.date(2024, 1, 15), second), (None, datetime.date(2024, 1, 1), first),
            ("8", datetime.date(2024, 1, 1), first), ("8", datetime.date(2024, 1, 29), second)]
    days = TI.day_rows(spark.createDataFrame(rows, "id string, start date, codes array<string>"), F.col("id"), F.col("start"))
    hits = sorted((r.employee, r.rule, str(r.from_date), str(r.to_date), r.value, r.crosses) for r in TI.timeline_violations(days, 60, 6).collect())
    assert hits == [("7", "max_consecutive", "2024-01-10", "2024-01-18", 9, True), ("7", "max_rolling_7d", "2024-01-09", "2024-01-19", 76, True),
                    ("7", "shift_gap", "2024-01-14", "2024-01-15", 0, True)]
    one = TI.day_rows(spark.createDataFrame(rows[:1], "id string, start date, codes array<string>"), F.col("id"), F.col("start"))
    assert TI.timeline_violations(one, 60, 6).count() == 0


def test_a_card_of_very_many_rows_keeps_a_state_of_fixed_size(spark):
    n = 60_000
    v = spark.range(n).select(F.lit(1).alias("roster_id"), F.col("id").cast("int").alias("row_idx"), F.lit(0).alias("ord"), F.lit("").alias("id_no"),
                              F.lit("Unspecified").alias("name"), F.lit("S").alias("station"), F.lit("6-1").alias("matrix"),
                              F.when(F.col("id") % 2 == 0, "Daily Hours Check").otherwise("Maximum Weekly Hours").alias("type"),
                              F.concat(F.lit("Wk A: detail "), F.col("id").cast("string")).alias("details"))
    cards = A.violation_cards(v)
    assert "collect_" not in cards._jdf.queryExecution().executedPlan().toString()
    [card] = cards.collect()
    assert (card.rules, card.n_violations, card.structural, card.failed_weeks, card.row_idx) == (
        "Daily Hours Check, Maximum Weekly Hours", 2, 1, "Week A", 0)


def test_policy_documents(spark):
    from shiftledger.sources.policy import check_documents
    good = '"max_week_hrs": 60, "min_week_hrs": 48, "max_rolling_7d_hrs": 60, "nw_credit_hrs": 0'
    docs = {"ok": f'{{"thresholds": {{{good}}}, "active_rule_keys": ["max_day"]}}', "null": f'{{"thresholds": {{{good}}}, "active_rule_keys": null}}',
            "none": f'{{"thresholds": {{{good}}}}}', "empty": f'{{"thresholds": {{{good}}}, "active_rule_keys": []}}',
            "bool": f'{{"thresholds": {{{good.replace("60,", "true,", 1)}}}}}', "text": f'{{"thresholds": {{{good.replace("48", chr(34) + "48" + chr(34))}}}}}',
            "more": f'{{"thresholds": {{{good}, "x": 1}}}}', "less": '{"thresholds": {"max_week_hrs": 60}}', "list": '{"thresholds": [1]}',
            "keys": f'{{"thresholds": {{{good}}}, "active_rule_keys": "all"}}', "mixed": f'{{"thresholds": {{{good}}}, "active_rule_keys": ["a", 1]}}', "broken": "{"}
    got = {r.policy_id: r.error for r in check_documents(spark.createDataFrame(list(docs.items()), "policy_id string, doc string")).collect()}
    names = "thresholds must contain exactly these keys: ['max_rolling_7d_hrs', 'max_week_hrs', 'min_week_hrs', 'nw_credit_hrs']"
    assert got == {"ok": None, "null": None, "none": None, "empty": None, "bool": "thresholds['max_week_hrs'] must be numeric, got bool",
                   "text": "thresholds['min_week_hrs'] must be numeric, got str", "more": names, "less": names, "list": "thresholds must be a dict",
                   "keys": "active_rule_keys must be None or a list[str]", "mixed": "active_rule_keys must be None or a list[str]", "broken": "not a JSON document"}


def test_saves_of_values_that_are_no_list(spark):
    from shiftledger.operators import logs as L
    head = "2024-05-01 10:00:00 | AUDIT | trace_id=t | "
    texts = ["thresholds={'a': 1} active_rule_keys={'x': 1}", "active_rule_keys=5", "active_rule_keys=None", "thresholds={'a': 1}", "active_rule_keys=['max_day']"]
    lines = [("audit.log", k, f'{head}action="admin_defaults_saved" user_id="u" {t}') for k, t in enumerate(texts)]
    feed = L.change_feed(L.log_records(spark.createDataFrame(lines, "file string, line_no bigint, value string")))
    got = [r.summary for r in feed.orderBy("line_no").collect()]
    assert got[:4] == ["Thresholds updated", "Defaults saved", "Active rules set to code defaults", "Thresholds updated · Active rules set to code defaults"]
