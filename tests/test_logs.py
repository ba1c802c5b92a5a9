"""Log files on disk, line formats, redaction, tail, change feed."""

import datetime

import pytest
from pyspark.sql import functions as F

from shiftledger import dims
from shiftledger.functions import text as X
from shiftledger.operators import logs as L
from shiftledger.sources import logs as SL
from shiftledger.sources import policy as SP
from shiftledger.sources import sinks


def lines_of(spark, *values, file="audit.log"):
    return spark.createDataFrame([(file, i + 1, v) for i, v in enumerate(values)], "file string, line_no bigint, value string")


def test_scan_keeps_line_order_across_splits(spark, tmp_path):
    wanted = {}
    for name, n in (("app.log", 5000), ("audit.log.2024-01-02", 40), ("app.json.log", 3)):
        wanted[name] = [f"{name} line {i} " + "x" * (i % 50) for i in range(n)]
        (tmp_path / name).write_text("\n".join(wanted[name]) + "\n")
    for name in ("app.log.bak", "web.log", "app.log.2024-1-2"):
        (tmp_path / name).write_text("no\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = SL.scan_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    found = {}
    for r in sorted(got, key=lambda r: r.line_no):
        found.setdefault(r.file, []).append(r.value)
    assert found == wanted
    assert {(r.file, r.stream, r.date_label) for r in got} == {
        ("app.log", "app", dims.LIVE_LABEL), ("audit.log.2024-01-02", "audit", "2024-01-02"), ("app.json.log", "app.json", dims.LIVE_LABEL)}
    listed = SL.read_archive_list(spark, str(tmp_path)).collect()
    assert [r.file for r in listed] == ["app.log", "app.json.log", "audit.log.2024-01-02"]
    assert listed[0]["size"] == (tmp_path / "app.log").stat().st_size


def test_retention(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-03-01",), (dims.LIVE_LABEL,)], "date_label string")
    kept = SL.retained(df, F.lit(datetime.date(2024, 4, 10))).collect()
    assert [r.date_label for r in kept] == ["2024-03-01", dims.LIVE_LABEL]


@pytest.mark.parametrize("line,want", [
    ('{"ts":"2024-01-01T00:00:00","level":"INFO","logger":"a","trace_id":"t","message":"m"}', ("2024-01-01T00:00:00", "INFO", "a", "t", "m")),
    ('  {"level":"INFO", "n": 5, "message": "x"}', ("", "INFO", "", "", "x")),
    ('{"message": 12}', ("", "", "", "", "12")),
    ("{broken", ("", "", "", "", "{broken")),
    ("{'message': 'single'}", ("", "", "", "", "{'message': 'single'}")),
    ("2024-01-01 00:00:00 | ERROR    | app.x | trace_id=t1 | a | b", ("2024-01-01 00:00:00", "ERROR", "app.x", "t1", "a | b")),
    ("2024-01-01 00:00:00 | AUDIT | trace_id=t2 | action=\"x\"", ("2024-01-01 00:00:00", "INFO", "audit", "t2", 'action="x"')),
    ("2024-01-01 00:00:00 | INFO | trace_id=t2 | no logger", ("", "", "", "", "2024-01-01 00:00:00 | INFO | trace_id=t2 | no logger")),
    ("2024-01-01 00:00:00 | AUDIT | l | trace_id=t | m", ("2024-01-01 00:00:00", "AUDIT", "l", "t", "m")),
    ("2024-01-01 00:00:00 | INFO | l | trace_id=t | a\x01b", ("2024-01-01 00:00:00", "INFO", "l", "t", "a\x01b")),
    ("Traceback", ("", "", "", "", "Traceback")),
])
def test_parse_line(spark, line, want):
    r = L.parse_log(lines_of(spark, line)).first()
    assert (r.ts, r.level, r.logger, r.trace_id, r.message) == want and r.raw == line


@pytest.mark.parametrize("line,want", [
    ("Authorization: bearer abc.DEF-1", "Authorization: Bearer ***"),
    ("x eyJabc.def.ghi y", "x ***jwt*** y"),
    ('refresh_token = "abc" z', 'refresh_token="***" z'),
    ("GET /cb?code=xyz&state=1", "GET /cb?code=***&state=1"),
    ("error code=42", "error code=42"),
    ("PASSWORD=hunter2 Api-Key=k", 'PASSWORD="***" Api-Key="***"'),
    ("mytoken=abc", "mytoken=abc"),
    ("mail a.b+c@example.com", "mail a.b+c@example.com"),
])
def test_redact(spark, line, want):
    assert lines_of(spark, line).select(X.redact(F.col("value"))).first()[0] == want


def test_redact_mail(spark):
    assert lines_of(spark, "to a.b@ex.com.").select(X.redact(F.col("value"), True)).first()[0] == "to ***@***."


def test_json_lines_redacted_before_or_after_parsing(spark):
    line = '{"ts":"2024-01-01T00:00:00","level":"ERROR","message":"token=abc password=x"}'
    broken = L.log_records(lines_of(spark, line)).first()
    assert broken.level == "" and "abc" not in broken.raw
    kept = L.log_records(lines_of(spark, line), json_first=True).first()
    assert kept.level == "ERROR" and kept.message == 'token="***" password="***"' and "abc" not in kept.raw


@pytest.mark.parametrize("ts,ok", [("2024-01-01 00:00:00", True), ("2024-01-01T23:59:59", True), ("2024-02-30 00:00:00", False),
                                   ("2024-01-01 00:00:00.5", False), ("2024-01-01T00:00:00Z", False), ("", False)])
def test_parse_ts(spark, ts, ok):
    assert (lines_of(spark, ts).select(X.parse_ts(F.col("value"))).first()[0] is not None) == ok


def test_filter_keeps_blank_levels_and_drops_blank_lines(spark):
    rec = L.parse_log(lines_of(spark, "raw text", "   ", "2024-01-01 00:00:00 | DEBUG | l | trace_id=t | m"))
    assert [r.raw for r in L.log_filter(rec, levels=["ERROR"]).collect()] == ["raw text"]
    assert L.log_filter(rec, since="2023-01-01 00:00:00").count() == 1
    assert L.log_filter(rec, grep="RAW.TEXT").count() == 0 and L.log_filter(rec, grep="RAW.TEXT", regex=True).count() == 1


def brute_tail(lines, max_lines, max_bytes):
    blob = b"".join(line.encode() + b"\n" for line in lines)
    kept = blob[-max_bytes:]
    out = kept.decode(errors="replace").splitlines()
    if len(blob) > max_bytes:
        out = out[1:]
    return out[-max_lines:]


def test_tail(spark):
    values = ["é" * (i % 7) + str(i) for i in range(60)]
    for max_lines, max_bytes in ((5, 10_000), (100, 57), (100, 58), (100, 59), (1, 1), (60, sum(len(v.encode()) + 1 for v in values))):
        got = [r.value for r in L.tail(lines_of(spark, *values), max_lines, max_bytes).orderBy("line_no").collect()]
        assert got == brute_tail(values, max_lines, max_bytes), (max_lines, max_bytes)


def audit(body):
    return f"2024-01-01 00:00:00 | AUDIT | trace_id=t | {body}"


def test_change_feed_texts(spark):
    save = 'action="admin_defaults_saved" user_id="u" thresholds={\'max_week_hrs\': 60} active_rule_keys='
    feed = L.change_feed(L.parse_log(lines_of(
        spark, audit(save + "['max_day', 'zzz']"), audit(save + "['max_day', 'min_rd']"), audit('action="other"'),
        audit('action="admin_defaults_save_failed" user_id="u" error="disk"'), audit(save + "None"), audit(save + "['min_rd']"),
        audit('action="admin_defaults_reset_to_factory" user_id=""'), audit(save + "[]"), audit(save + "[]"), audit(save + "open('x')"))))
    got = [(r.summary, r.detail) for r in feed.orderBy("line_no").collect()]
    head = "Thresholds updated · "
    assert got == [
        (head + "Pinned set: 2 active rule(s)", "max_week_hrs=60 — Daily Hours Check, zzz"),
        (head + "Pinned 1 rule(s) · Unpinned 1 rule(s)", "max_week_hrs=60 — added: Minimum Rest Days — removed: zzz"),
        ("⚠️ Save FAILED", "disk"),
        (head + "Active rules set to code defaults", "max_week_hrs=60"),
        (head + "Pinned 1 active rule(s)", "max_week_hrs=60 — Minimum Rest Days"),
        ("Reset to factory defaults", "All thresholds restored; active rules set to code defaults."),
        (head + "Pinned 0 active rule(s)", "max_week_hrs=60"),
        (head + "Saved (no active-rule change)", "max_week_hrs=60"),
        (head + "Active rules set to code defaults", "max_week_hrs=60"),
    ]
    assert [r.user_id for r in feed.filter("line_no = 7").collect()] == ["unknown"]
    kpis = L.change_kpis(feed).first()
    assert (kpis.changes, kpis.saves, kpis.resets, kpis.failures) == (9, 7, 1, 1)


def test_feed_across_archives(spark):
    save = 'action="admin_defaults_saved" user_id="u" active_rule_keys='
    a = lines_of(spark, audit(save + "['max_day']"), file="audit.log.2024-01-01")
    b = lines_of(spark, audit(save + "['min_rd']"), file="audit.log")
    rec = L.parse_log(a.unionByName(b))
    alone = L.change_feed(rec).filter("file = 'audit.log'").first()
    chained = L.change_feed(rec, across_archives=True).filter("file = 'audit.log'").first()
    assert alone.summary == "Pinned set: 1 active rule(s)" and chained.summary == "Pinned 1 rule(s) · Unpinned 1 rule(s)"


def test_histogram_bins(spark):
    rec = L.parse_log(lines_of(spark, *[f"2024-01-01 00:{m:02d}:00 | INFO | l | trace_id=t | m" for m in range(60)], "2024-01-01 02:00:00 | odd | l | trace_id=t | m",
                               "2024-01-01 02:00:00 | ODD | l | trace_id=t | m"))
    h = L.severity_histogram(rec).collect()
    assert {r.width for r in h} == {300} and sum(r.events for r in h) == 61
    assert [r.events for r in h if r.level == "DEBUG"] == [1]


def test_policy_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"thresholds": {"max_week_hrs": 55.9, "min_week_hrs": true, "nw_credit_hrs": "8"}, "active_rule_keys": ["max_day", 5]}')
    (tmp_path / "b.json").write_text("not json")
    (tmp_path / "c.json").write_text('{"active_rule_keys": []}')
    rows = {r.policy_id: r for r in SP.load_policy(spark, str(tmp_path)).collect()}
    a = rows["a"]
    assert (a.max_week_hrs, a.min_week_hrs, a.max_rolling_7d_hrs, a.nw_credit_hrs, a.active_rule_keys) == (55, 1, 60, 0, None)
    assert rows["b"].max_week_hrs == 60 and rows["c"].active_rule_keys == []


def test_exports(spark, tmp_path):
    rec = L.parse_log(lines_of(spark, audit('action="admin_defaults_reset_to_factory" user_id="u"'), "plain"))
    sinks.export_logs(rec, str(tmp_path / "logs"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "logs")).collect()) == sorted(r.raw for r in rec.collect())
    sinks.export_changes(L.change_feed(rec), str(tmp_path / "changes"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "changes"))
    assert back.columns == ["timestamp", "user_id", "action", "summary", "detail"] and back.first().summary == "Reset to factory defaults"


def test_lines_that_no_fixture_holds(spark):
    rows = ['\t{"level": "ERROR", "message": "m"} ', '{"event": "x"}', '{"level": null, "message": "n"}', '{"level": "INFO"', "2024-01-02  03:04:05 | INFO | a | trace_id=t | z"]
    lines = spark.createDataFrame([("app.log", k, v) for k, v in enumerate(rows)], "file string, line_no bigint, value string")
    got = {r.line_no: r for r in L.parse_log(lines).withColumn("at", X.parse_ts(F.col("ts")).cast("string")).collect()}
    assert (got[0].level, got[0].message) == ("ERROR", "m")
    assert (got[1].level, got[1].message, got[1].ts) == ("", "", "")
    assert (got[2].level, got[2].message) == ("None", "n")
    assert (got[3].level, got[3].message) == ("", rows[3])
    assert (got[4].level, got[4].at) == ("INFO", "2024-01-02 03:04:05")


def test_scan_keeps_equal_names_apart_and_opens_only_wanted_files(spark, tmp_path):
    from shiftledger.sources.logs import scan_logs

    for host in ("h1", "h2"):
        (tmp_path / f"host={host}").mkdir()
        for name in ("app.log.2024-01-01", "app.log.2024-01-02", "notes.txt"):
            (tmp_path / f"host={host}" / name).write_text("".join(f"{host} {name} {k}\n" for k in range(3)))
    got = scan_logs(spark, str(tmp_path), "app", "2024-01-01")
    rows = sorted((r.value.split()[0], r.line_no, r.value.split()[2], r.file) for r in got.collect())
    first = min(r[1] for r in rows)
    assert rows == [(h, first + k, str(k), "app.log.2024-01-01") for h in ("h1", "h2") for k in range(3)]
    assert got.select("path").distinct().count() == 2
    assert scan_logs(spark, str(tmp_path)).count() == 12
