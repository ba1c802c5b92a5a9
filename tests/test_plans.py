"""Physical plans: no shuffle where none is needed, pruned scans, JVM-only hot paths."""

import re

import pytest
from pyspark.sql import functions as F

from shiftledger.functions import text as X
from shiftledger.operators import logs as L
from shiftledger.operators import reports as A
from shiftledger.operators import roster as O
from shiftledger.operators.rules import validate
from shiftledger.plans import fixtures as D

SF = "/root/testdata/sf0.001"


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def exchanges(df):
    return plan(df).split("\n\n")[0].count("Exchange")


@pytest.fixture(scope="module")
def results(spark):
    return validate(D.roster_synth(spark, SF))


def test_validate_is_narrow_and_without_python(results):
    p = plan(results)
    assert "Exchange" not in p and "Python" not in p


def test_filter_runs_on_flags_above_the_features(results):
    tree = plan(O.violations_only(results)).split("\n\n")[0]
    assert tree.index("Filter") < tree.index("Generate")
    p = plan(O.violations_only(results))
    condition = re.search(r"Filter.*?Condition : (.*)", p, re.S).group(1).split("\n")[0]
    assert "codes" not in condition and "transform" not in condition


def test_counts_do_not_build_messages(results):
    p = plan(A.compliance_kpis(results))
    assert "consecutive work days in" not in p and "Invalid: " not in p


def test_report_shuffles_once(results):
    assert exchanges(A.compliance_kpis(results)) == 1
    assert exchanges(A.matrix_distribution(results)) == 2  # group, then the order of a few rows
    assert exchanges(A.top_violations(results)) <= 2


def test_scan_reads_needed_columns_only(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", X.redact(F.col("text")).alias("t"))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan(df))
    lines = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 5").select("doc_id")
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,5)]" in plan(lines)


def test_generated_methods_stay_small_enough_for_the_jit(spark, results):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = A.compliance_kpis(validate(D.roster_synth(spark, SF)))
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000


def test_tail_filters_before_its_window(spark):
    lines = D.table(spark, SF, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("line_no"), F.col("props").alias("value"))
    tree = plan(L.tail(lines, 10, 1000)).split("\n\n")[0]
    assert tree.count("Window (") == 1 and tree.index("Window (") < tree.index("Join")


def test_log_fields_are_parsed_once(spark):
    rec = L.parse_log(spark.createDataFrame([("f", 1, "x")], "file string, line_no bigint, value string"))
    p = plan(L.log_filter(rec, levels=["ERROR"], since="2024-01-01 00:00:00"))
    assert p.count("from_json") <= 2


def test_cards_are_ranked_with_four_exchanges(spark, results):
    """One for the wide side, three for the small table of counts; no list of details, and cards are read from their table."""
    cards = A.violation_cards(A.explode_violations(results))
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        tree = A.rank_violations(cards)._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert tree.count("Exchange ") <= 4
    assert "collect_" not in cards._jdf.queryExecution().executedPlan().toString()


def test_summary_reads_results_twice(spark):
    tree = plan(A.export_summary(validate(D.roster_synth(spark, SF)))).split("\n\n")[0]
    assert len(re.findall(r"Scan parquet", tree)) <= 2
