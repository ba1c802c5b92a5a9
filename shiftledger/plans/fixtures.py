"""Rosters, grids and logs derived by Spark from the given tables, row for row (no sampling)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger.operators.ordering import number_rows
from shiftledger.shared import shared_dir

PATTERNS = [
    "AOT AOT AOT AOT RD RD RD AOT AOT AOT AOT RD RD RD",
    "A A A A A A RD B B B B B B RD",
    "OS5 OS5 OS5 OS5 A RD RD OS5 OS5 OS5 OS5 A RD RD",
    "AOT AOT AOT AOT AOT RD A AOT AOT AOT AOT AOT RD A",
    "AOT AOT A A AOT RD RD A A A AOT AOT RD RD",
    "AOT AOT AOT A A A RD AOT AOT AOT A A A RD",
    "C A C A C A RD AOT AOT RD AOT RD AOT RD",
    "Leave Leave RH SPH NW RD RD Leave Leave Leave NW NW RD RD",
    "A A A A A A A A A A A A A A",
    "BOT BOT BOT RD RD RD RD COT COT COT COT COT COT RD",
]
OVERRIDES = ["Leave", "RH", "SPH", "NW", "AWOL", "RD", "AOT", "XX", "", "OS5", "C"]
ROSTER_SIZE = 500
PERIODS = 100_000  # roster numbers of one group of users, one for each period


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def roster_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster_from_customers(table(spark, sf_dir, "customer"))


def roster_from_customers(customers: DataFrame) -> DataFrame:
    """One employee per customer; rosters of 500 employees."""
    k = F.col("c_custkey")
    patterns = "array(" + ", ".join("array(" + ", ".join(f"'{c}'" for c in p.split()) + ")" for p in PATTERNS) + ")"
    override = "get(array(" + ", ".join(f"'{c}'" for c in OVERRIDES) + "), cast((c_custkey div 14) % 11 as int))"
    codes = F.expr(f"transform(get({patterns}, cast(c_custkey % 10 as int)), "
                   f"(c, d) -> if(c_custkey % 4 = 0 and d = c_custkey % 14, {override}, c))")
    return customers.select(
        F.floor(k / ROSTER_SIZE).cast("bigint").alias("roster_id"),
        (k % ROSTER_SIZE).cast("int").alias("row_idx"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("station"),
        F.col("c_nationkey").cast("string").alias("emp_status"),
        k.cast("string").alias("id_no"),
        codes.alias("codes"),
    )


def _ts_text(n: int):
    return F.substring(F.col("ts").cast("string"), 1, n)


def _level():
    t = F.col("event_type")
    return F.when(t == "error", "ERROR").when(t == "signup", "WARNING").when(t == "click", "DEBUG").otherwise("INFO")


def _numbered(df: DataFrame) -> DataFrame:
    """Give each line its place in the file; hours are the buckets, so a busy day is not sorted by one task."""
    return number_rows(df, ["file"], [], F.date_trunc("hour", "ts"), ["ts", "event_id"], "line_no")


def log_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per event in three formats, with unparseable lines and secrets: (file, line_no, value)."""
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    json = F.concat(
        F.lit('{"ts":"'), F.replace(_ts_text(19), F.lit(" "), F.lit("T")), F.lit('","level":"'), _level(),
        F.lit('","logger":"app.main","trace_id":"sesh-'), user, F.lit('","message":"event '), F.col("event_type"), F.lit('"}'))
    audit = F.concat(
        _ts_text(19), F.lit(" | AUDIT | trace_id=sesh-"), user, F.lit(' | action="'), F.col("event_type"),
        F.lit('" user_id="user'), user, F.lit('@example.com" ip="10.0.0.'), (F.col("user_id") % 250).cast("string"),
        F.lit('" user_agent="ua"'))
    text = F.concat(
        _ts_text(19), F.lit(" | "), F.rpad(_level(), 8, " "), F.lit(" | app.main | trace_id=sesh-"), user,
        F.lit(" | event "), F.col("event_type"), F.lit(" token=abc"), e.cast("string"))
    value = (F.when(e % 17 == 0, F.concat(F.lit("Traceback line "), e.cast("string")))
             .when(e % 4 == 0, json).when(e % 4 == 1, audit).otherwise(text))
    events = table(spark, sf_dir, "events")
    lines = events.select(F.concat(F.lit("app.log."), _ts_text(10)).alias("file"), "ts", "event_id", value.alias("value"))
    return _numbered(lines).select("file", "line_no", "value")


def change_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit lines, one per event: sign-ups change settings, other events are ordinary lines between them."""
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    keys = F.get(F.array(*[F.lit(x) for x in (
        "None", '["max_day", "min_rd"]', '["max_day", "max_week", "min_rd"]', '["shift_gap"]', "[]")]), (e % 5).cast("int"))
    body = (
        F.when(e % 7 == 5, F.concat(F.lit('action="admin_defaults_reset_to_factory" user_id="user'), user, F.lit('"')))
        .when(e % 7 == 6, F.concat(F.lit('action="admin_defaults_save_failed" user_id="user'), user, F.lit('" error="disk full"')))
        .otherwise(F.concat(
            F.lit('action="admin_defaults_saved" user_id="user'), user, F.lit('" thresholds={"max_week_hrs": '),
            (50 + e % 20).cast("string"), F.lit(', "min_week_hrs": 48, "max_rolling_7d_hrs": 60, "nw_credit_hrs": 0} active_rule_keys='),
            keys)))
    other = F.concat(F.lit('action="'), F.col("event_type"), F.lit('" user_id="user'), user, F.lit('"'))
    body = F.when(F.col("event_type") == "signup", body).otherwise(other)
    events = table(spark, sf_dir, "events")
    lines = events.select(
        F.concat(F.lit("audit.log."), _ts_text(10)).alias("file"), "ts", "event_id",
        F.concat(_ts_text(19), F.lit(" | AUDIT | trace_id=sesh-"), user, F.lit(" | "), body).alias("value"))
    return _numbered(lines).select("file", "line_no", "value")


def log_folder(spark: SparkSession, lines: DataFrame) -> str:
    """Lines (file, line_no, value) as text files, in folders whose names `FILE_NAME` reads."""
    path = shared_dir(spark, "archives")
    lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", "value").write.partitionBy("file").text(path)
    return path


def roster_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rosters from activity, one row per user and 14-day period with events: a day is a work code when events happened
    on it, else RD."""
    e = table(spark, sf_dir, "events")
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    days = e.groupBy("user_id", F.floor(day / 14).alias("period"), F.pmod(day, F.lit(14)).alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.hour("ts")).alias("h"))
    code = F.concat(F.when(F.col("h") < 6, "C").when(F.col("h") < 14, "A").otherwise("B"),
                    F.when(F.col("n") >= 3, "OT").otherwise(""))
    worked = days.groupBy("user_id", "period").agg(F.map_from_entries(F.collect_list(F.struct("d", code.alias("c")))).alias("m"))
    codes = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit("RD")))
    return worked.select(
        (F.floor(F.col("user_id") / ROSTER_SIZE) * PERIODS + F.col("period")).cast("bigint").alias("roster_id"),
        (F.col("user_id") % ROSTER_SIZE).cast("int").alias("row_idx"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"), F.lit("events").alias("station"),
        F.lit("").alias("emp_status"), F.col("user_id").cast("string").alias("id_no"), codes.alias("codes"))


FILE_ROWS = 50


FILE_NAME = "regexp_extract(_metadata.file_path, '/file=([^/]*)/', 1)"


def grid_folder(spark: SparkSession, sf_dir: str, path: str | None = None, where: Column | None = None) -> str:
    """A folder of uploaded files built from rosters, 50 employees each; `FILE_NAME` makes their names from paths.

    ``where`` chooses files by their number ``n``; they are added to what is in ``path``.

    Every 7th file has no header row, every 11th an unsupported extension, every 13th a .xlsx name without the
    signature; aliases, lower case, date rows, formula names and line breaks in cells occur in the rest.
    """
    r = roster_synth(spark, sf_dir)
    k = F.col("id_no").cast("bigint")
    shown = F.transform("codes", lambda c: F.when(k % 6 == 0, F.lower(c)).when((k % 6 == 1) & (c == "A"), "AS").otherwise(c))
    name = F.when(k % 40 == 3, "12/01/2024").when(k % 40 == 5, "=A1").when(k % 40 == 7, F.concat("name", F.lit('\n""x"", y'))).otherwise(F.col("name"))
    line = F.concat_ws(",", "station", "emp_status", "id_no", F.concat(F.lit('"'), name, F.lit('"')),
                       F.array_join(F.slice(shown, 1, 7), ","), F.lit(""), F.array_join(F.slice(shown, 8, 7), ","))
    n = F.floor(k / FILE_ROWS)
    days = "Mon,Tue,Wed,Thu,Fri,Sat,Sun"
    head = F.when(F.col("n") % 7 == 6, "no header here" + "," * 18).otherwise(
        f"Station/Designation,Employee Status,ID NO.,Operator's Name:,{days},SPACER,{days}")
    above = [F.struct(F.lit(k).cast("bigint").alias("k"), v.alias("value")) for k, v in ((-3, F.lit("Site plan" + "," * 18)), (-2, F.lit("")), (-1, head))]
    lines = r.select(n.alias("n"), k.alias("k"), line.alias("value"))
    tops = r.select(n.alias("n")).distinct().select("n", F.inline(F.array(*above)))
    ext = F.when(F.col("n") % 11 == 10, "txt").when(F.col("n") % 13 == 12, "xlsx").otherwise("csv")
    named = lines.unionByName(tops).withColumn("file", F.concat(F.lit("roster_"), F.col("n").cast("string"), F.lit("."), ext))
    path = path or shared_dir(spark, "uploads")
    named = named if where is None else named.filter(where)
    # Files are many and small: a number of tasks that is not lowered by bytes, and no renames by the driver at the end.
    dealt = named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").sortWithinPartitions("file", "k")
    dealt.select("file", "value").write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("file").text(path)
    return path


def policy_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON policy per supplier, some partial, mistyped or broken: (policy_id, doc)."""
    k = F.col("s_suppkey")
    doc = (
        F.when(k % 5 == 0, F.format_string('{"thresholds": {"max_week_hrs": %d, "min_week_hrs": 40}}', 50 + k % 30))
        .when(k % 5 == 1, F.format_string('{"thresholds": {"max_week_hrs": "%d", "nw_credit_hrs": 8.9}, "active_rule_keys": ["max_day", "min_rd"]}', k))
        .when(k % 5 == 2, F.lit('{"thresholds": 5, "active_rule_keys": "all"}'))
        .when(k % 5 == 3, F.lit('{"thresholds": {broken'))
        .otherwise(F.lit('{"thresholds": {"max_rolling_7d_hrs": 90}, "active_rule_keys": null}')))
    return table(spark, sf_dir, "supplier").select(k.cast("string").alias("policy_id"), doc.alias("doc"))


def period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week labels and dates per roster; week B of every third roster has no date."""
    ids = roster_synth(spark, sf_dir).select("roster_id").distinct()
    weeks = ids.select("roster_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("week"))
    day = F.date_add(F.lit("2024-05-01").cast("date"), (F.col("roster_id") % 5).cast("int") + F.when(F.col("week") == "B", 7).otherwise(0))
    return weeks.select(
        "roster_id", "week", F.concat(F.lit("Week "), F.col("week")).alias("label"),
        F.when(~((F.col("week") == "B") & (F.col("roster_id") % 3 == 0)), day).alias("start_date"))
