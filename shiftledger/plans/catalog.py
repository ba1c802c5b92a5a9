"""Every registered query: (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger import dims
from shiftledger.functions import roster as R
from shiftledger.functions import text as X
from shiftledger.operators import logs as L
from shiftledger.operators import reports as A
from shiftledger.operators import roster as O
from shiftledger.operators import rules as V
from shiftledger.operators import timeline as TI
from shiftledger.plans import fixtures as D
from shiftledger.plans import oracle as Q
from shiftledger.sources import grid as G
from shiftledger.sources import logs as SL
from shiftledger.sources import policy as SP
from shiftledger.sources import sinks as K
from shiftledger.shared import shared_dir
from shiftledger.streaming import arrival as TA
from shiftledger.streaming import limits as TL
from shiftledger.streaming import live as TV
from shiftledger.streaming import sessions as TS

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        CATALOG[name] = (fn, sql)
        return fn
    return add


def _results(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return V.validate(D.roster_synth(spark, sf), **kw)


def _big(df: DataFrame, *cols: str) -> DataFrame:
    """Counts and small numbers leave as BIGINT, so both engines name the same type."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


KEY = ["roster_id", "row_idx"]
B = "cast({0} as bigint) {1}"


def b(expr: str, name: str | None = None) -> str:
    return f"cast({expr} as bigint) {name or expr}"


# --- sources -------------------------------------------------------------------------------------

def _grid_lines(spark, sf):
    return G.scan_roster_grid(G.read_text(spark, D.grid_folder(spark, sf), D.FILE_NAME))[0]


FILES = f"""
    with ro as ({Q.roster()}), k as (select *, cast(id_no as bigint) k, cast(id_no as bigint) // 50 n from ro),
    fl as (select n, concat('roster_', n, '.', case when n % 11 = 10 then 'txt' when n % 13 = 12 then 'xlsx' else 'csv' end) file, count(*) emp,
             case when n % 11 = 10 then 'Unsupported extension: .txt. Upload .xlsx, .xls, or .csv.'
                  when n % 13 = 12 then 'File content does not match .xlsx signature. Try re-saving as Excel Workbook.' end bad,
             n % 7 = 6 headless from k group by n)"""


@query("scan_roster_grid", FILES + f"""
    select file, {b('r.row_idx', 'row_idx')}, {b('19', 'n_cells')},
      case when r.row_idx = 0 then 'Site plan' when r.row_idx = 1 then case when headless then 'no header here' else 'Station/Designation' end
           else k.station end first_cell
    from fl, (select unnest(range(0, 52)) row_idx) r left join k on true
    where bad is null and ((r.row_idx < 2 and k.k = (select min(k) from k k2 where k2.n = fl.n)) or (k.n = fl.n and r.row_idx = k.k - (select min(k) from k k2 where k2.n = fl.n) + 2 ))
      and k.n = fl.n""")
def scan_roster_grid(spark, sf):
    cells = _grid_lines(spark, sf)
    return _big(cells.select("file", "row_idx", F.size("cells").alias("n_cells"), F.get("cells", F.lit(0)).alias("first_cell")),
                "row_idx", "n_cells")


@query("guard_files", FILES + " select file, coalesce(bad, 'ok') reason from fl")
def guard_files(spark, sf):
    files = G.list_files(spark, D.grid_folder(spark, sf), D.FILE_NAME)
    return G.guard_files(files, dims.MAX_FILE_BYTES).select("file", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query("guard_cells", f"""
    select concat('events_', event_type) file, concat('File rejected: workbook contains ', format('{{:,}}', count(*) * 300),
      ' cells, which exceeds the 500,000-cell safety limit.') reason from events group by event_type having count(*) * 300 > 500000
    union all select concat('events_', event_type), 'ok' from events group by event_type having count(*) * 300 <= 500000""")
def guard_cells(spark, sf):
    e = D.table(spark, sf, "events")
    cells = e.select(F.concat(F.lit("events_"), "event_type").alias("file"), F.lit(0).alias("sheet_no"),
                     F.col("event_id").cast("int").alias("row_idx"), F.array_repeat(F.lit(""), 300).alias("cells"))
    bad = G.guard_cells(cells, dims.MAX_FILE_CELLS)
    return cells.select("file").distinct().join(bad, "file", "left").select("file", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query("detect_header", FILES + f"""
    select file, {b('1', 'row_idx')}, '4,5,6,7,8,9,10,12,13,14,15,16,17,18' day_cols from fl where bad is null and not headless""")
def detect_header(spark, sf):
    h = G.detect_header(_grid_lines(spark, sf))
    return h.select("file", F.col("header.row_idx").cast("bigint").alias("row_idx"),
                    F.array_join(F.col("header.day_cols").cast("array<string>"), ",").alias("day_cols"))


@query("detect_meta_columns", FILES + f"""
    select file, {b('3', 'name_col')}, {b('0', 'station_col')}, {b('1', 'status_col')}, {b('2', 'id_col')} from fl where bad is null and not headless""")
def detect_meta_columns(spark, sf):
    lines = _grid_lines(spark, sf)
    m = G.detect_meta_columns(lines, G.detect_header(lines))
    return m.select("file", *[F.col(f"meta.{r}").cast("bigint").alias(f"{r}_col") for r in dims.META_KEYWORDS])


@query("grid_rejects", FILES + """
    select file, coalesce(bad, 'No 14-day schedule columns found. Ensure ''Mon''–''Sun'' appear twice in your header row.') reason
    from fl where bad is not null or headless""")
def grid_rejects(spark, sf):
    return G.parse_files(spark, D.grid_folder(spark, sf), name=D.FILE_NAME)[1]


@query("parse_roster_rows", FILES + f"""
    select file roster_id, {b('k - (select min(k) from k k2 where k2.n = fl.n) + 2', 'row_idx')},
      case when k % 40 = 7 then concat(name, chr(10), '"x", y') else name end as name, station, emp_status, id_no,
      array_to_string(list_transform(codes, lambda c: case when upper(c) = 'LEAVE' then 'Leave' else upper(c) end), ',') codes
    from k join fl using (n) where bad is null and not headless and k % 40 not in (3, 5)""")
def parse_roster_rows(spark, sf):
    rows, _ = G.parse_files(spark, D.grid_folder(spark, sf), name=D.FILE_NAME)
    return _big(rows.withColumn("codes", F.array_join("codes", ",")), "row_idx")


LINES_SQL = Q.log_lines()


@query("scan_logs", LINES_SQL + """
    select file, line_no, value, 'app' stream, substr(file, 9) date_label from lines""")
def scan_logs(spark, sf):
    folder = D.log_folder(spark, D.log_synth(spark, sf))
    return SL.scan_logs(spark, folder, name=D.FILE_NAME).drop("path")


@query("list_archives", LINES_SQL + """
    select file, 'app' stream, substr(file, 9) date_label, cast(sum(strlen(value) + 1) as bigint) as size from lines group by file
    union all select 'app.log', 'app', 'Today (live)', cast(sum(strlen(value) + 1) as bigint) from lines""")
def list_archives(spark, sf):
    lines = D.log_synth(spark, sf)
    size = F.sum(F.octet_length("value") + 1).cast("bigint").alias("size")
    files = lines.groupBy("file").agg(size)
    other = lines.groupBy().agg(size).select(F.explode(F.array(F.lit("app.log"), F.lit("app.log.bak"), F.lit("web.log"))).alias("file"), "size")
    return SL.list_archives(files.unionByName(other))


POLICY_SQL = """
    with pol as (select s_suppkey k, cast(s_suppkey as varchar) policy_id,
      case when s_suppkey % 5 = 0 then 50 + s_suppkey % 30 else 60 end max_week_hrs,
      case when s_suppkey % 5 = 0 then 40 else 48 end min_week_hrs,
      case when s_suppkey % 5 = 4 then 90 else 60 end max_rolling_7d_hrs,
      case when s_suppkey % 5 = 1 then 8 else 0 end nw_credit_hrs,
      case when s_suppkey % 5 = 1 then 'max_day,min_rd' else 'default' end active from supplier)"""


def _policy(spark, sf):
    return SP.policies_from_json(D.policy_docs(spark, sf))


@query("load_policy", POLICY_SQL + f""" select policy_id, {b('max_week_hrs')}, {b('min_week_hrs')}, {b('max_rolling_7d_hrs')},
    {b('nw_credit_hrs')}, active from pol""")
def load_policy(spark, sf):
    p = _policy(spark, sf)
    return _big(p.select("policy_id", *dims.FACTORY_POLICY, F.coalesce(F.array_join("active_rule_keys", ","), F.lit("default")).alias("active")),
                *dims.FACTORY_POLICY)


@query("check_policy", """
    with p as (select s_suppkey, case when s_suppkey % 9 = 0 then null else s_suppkey % 100 end mx, s_suppkey % 70 mn,
                 s_suppkey % 90 ro, s_suppkey % 15 nw from supplier)
    select cast(s_suppkey as varchar) policy_id, concat_ws('; ',
      case when mx is null then 'max_week_hrs: missing' end, case when mx not between 40 and 84 then 'max_week_hrs: must be between 40 and 84' end,
      case when mn not between 0 and 60 then 'min_week_hrs: must be between 0 and 60' end,
      case when ro not between 40 and 84 then 'max_rolling_7d_hrs: must be between 40 and 84' end,
      case when nw not between 0 and 12 then 'nw_credit_hrs: must be between 0 and 12' end,
      case when mn >= mx then 'min_week_hrs: must be less than max_week_hrs' end) errors from p""")
def check_policy(spark, sf):
    k = F.col("s_suppkey")
    p = D.table(spark, sf, "supplier").select(
        k.cast("string").alias("policy_id"), F.when(k % 9 != 0, k % 100).cast("int").alias("max_week_hrs"),
        (k % 70).cast("int").alias("min_week_hrs"), (k % 90).cast("int").alias("max_rolling_7d_hrs"),
        (k % 15).cast("int").alias("nw_credit_hrs"))
    return SP.check_policy(p).select("policy_id", F.array_join("errors", "; ").alias("errors"))


# --- row features --------------------------------------------------------------------------------

DIRTY = f"""
    with ro as ({Q.roster()}), d as (select roster_id, row_idx, case cast(id_no as int) % 6 when 0 then null when 1 then '' when 2 then 'nan' when 3 then '  ' else name end as name,
      case when cast(id_no as int) % 5 = 0 then '' else station end station, emp_status, id_no, codes from ro)"""


def _dirty(spark, sf):
    k = F.col("id_no").cast("int")
    name = F.when(k % 6 == 0, None).when(k % 6 == 1, "").when(k % 6 == 2, "nan").when(k % 6 == 3, "  ").otherwise(F.col("name"))
    return D.roster_synth(spark, sf).withColumns({"name": name, "station": F.when(k % 5 == 0, "").otherwise(F.col("station"))})


@query("fill_meta", DIRTY + """ select roster_id, row_idx, case when name is null or name in ('', 'nan') then 'Unspecified' else name end as name,
    case when station = '' then 'Unspecified' else station end station, emp_status, id_no from d""")
def fill_meta(spark, sf):
    return O.fill_meta(_dirty(spark, sf)).select(*KEY, *O.META)


@query("fill_days", f"""with ro as ({Q.roster()}) select roster_id, row_idx, array_to_string(list_transform(range(14), lambda i:
    case when i < 14 - row_idx % 3 and codes[i + 1] <> 'NW' then codes[i + 1] else '' end), ',') codes from ro""")
def fill_days(spark, sf):
    r = D.roster_synth(spark, sf)
    cut = F.transform(F.slice("codes", F.lit(1), F.lit(14) - F.col("row_idx") % 3), lambda c: F.when(c != "NW", c))
    return O.fill_days(r.withColumn("codes", cut)).select(*KEY, F.array_join("codes", ",").alias("codes"))


@query("drop_blank_names", DIRTY + " select roster_id, row_idx, name from d where trim(coalesce(name, '')) <> ''")
def drop_blank_names(spark, sf):
    return O.drop_blank_names(_dirty(spark, sf)).select(*KEY, "name")


F4 = Q.features()


@query("day_hours", F4 + " select roster_id, row_idx, array_to_string(h, ',') as hours from f4")
def day_hours(spark, sf):
    return D.roster_synth(spark, sf).select(*KEY, F.array_join(R.day_hours(F.col("codes")).cast("array<string>"), ",").alias("hours"))


@query("week_hours", F4 + f" select roster_id, row_idx, {b('ha', 'hrs_a')}, {b('hb', 'hrs_b')}, {b('ha + hb', 'hrs')} from f4")
def week_hours(spark, sf):
    w = D.roster_synth(spark, sf).withColumn("w", R.week_hours(R.day_hours(F.col("codes"))))
    return _big(w.select(*KEY, F.col("w.a").alias("hrs_a"), F.col("w.b").alias("hrs_b"), F.col("w.total").alias("hrs")), "hrs_a", "hrs_b", "hrs")


@query("rd_counts", F4 + f""" select roster_id, row_idx, {b(Q.count("x = 'RD'", 1, 7), 'rd_a')}, {b(Q.count("x = 'RD'", 8, 14), 'rd_b')} from f4""")
def rd_counts(spark, sf):
    w = D.roster_synth(spark, sf).withColumn("w", R.rd_counts(F.col("codes")))
    return _big(w.select(*KEY, F.col("w.a").alias("rd_a"), F.col("w.b").alias("rd_b")), "rd_a", "rd_b")


@query("detect_matrix", F4 + " select roster_id, row_idx, matrix from f4")
def detect_matrix(spark, sf):
    return V.features(D.roster_synth(spark, sf)).select(*KEY, "matrix")


@query("detect_matrix_events", Q.features(Q.roster_events()) + " select roster_id, row_idx, matrix from f4")
def detect_matrix_events(spark, sf):
    return V.features(D.roster_events(spark, sf)).select(*KEY, "matrix")


@query("overtime", F4 + f" select roster_id, row_idx, {b('ot_a')}, {b('ot_b')}, {b('ot_a + ot_b', 'ot_total')} from f4")
def overtime(spark, sf):
    return _big(V.features(D.roster_synth(spark, sf)).select(*KEY, "ot_a", "ot_b", "ot_total"), "ot_a", "ot_b", "ot_total")


@query("rest_gap", F4 + """ select roster_id, row_idx, array_to_string(list_transform(gaps, lambda g: coalesce(cast(g as varchar), '-')), ',') gaps from f4""")
def rest_gap(spark, sf):
    gaps = F.transform(R.rest_gap(F.col("codes")), lambda g: F.coalesce(g.cast("string"), F.lit("-")))
    return D.roster_synth(spark, sf).select(*KEY, F.array_join(gaps, ",").alias("gaps"))


PERIOD = f"""
    with ids as (select distinct c_custkey // 500 roster_id from customer), wk as (select unnest(['A', 'B']) as week),
    pe as (select roster_id, week, concat('Week ', week) label, case when not (week = 'B' and roster_id % 3 = 0)
             then date '2024-05-01' + cast(roster_id % 5 + case when week = 'B' then 7 else 0 end as int) end start_date from ids, wk)"""
MONDAY = "cast(date_trunc('week', start_date) as date)"


@query("day_label", PERIOD + f""" select roster_id, {b('d', 'day_idx')}, case when start_date is null then concat({Q.DAY_LIST}[d + 1][1:3], ' ', label)
    else concat({Q.DAY_LIST}[d + 1][1:3], ' (', month({MONDAY} + cast(d % 7 as int)), '/', day({MONDAY} + cast(d % 7 as int)), ')') end label
    from pe, (select unnest(range(14)) d) where week = case when d < 7 then 'A' else 'B' end""")
def day_label(spark, sf):
    p = D.period(spark, sf).withColumn("day_idx", F.explode(F.when(F.col("week") == "A", F.sequence(F.lit(0), F.lit(6))).otherwise(F.sequence(F.lit(7), F.lit(13)))))
    return _big(p.select("roster_id", "day_idx", R.day_label(R.day_key(F.col("day_idx")), F.col("label"), F.col("start_date")).alias("label")), "day_idx")


@query("week_dates", f"""select o_orderkey, cast(cast(date_trunc('week', o_orderdate) as date) as varchar) monday,
    cast(cast(date_trunc('week', o_orderdate) as date) + 6 as varchar) sunday, cast(7 as bigint) as days from orders""")
def week_dates(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", R.week_dates(F.col("o_orderdate").cast("date")).alias("d"))
    return o.select("o_orderkey", F.get("d", F.lit(0)).cast("string").alias("monday"), F.get("d", F.lit(6)).cast("string").alias("sunday"),
                    F.size("d").cast("bigint").alias("days"))


@query("week_range", PERIOD + f""" select roster_id, week, case when start_date is null then '' else
    concat(' (', month({MONDAY}), '/', day({MONDAY}), ' – ', month({MONDAY} + 6), '/', day({MONDAY} + 6), ')') end week_range from pe""")
def week_range(spark, sf):
    return D.period(spark, sf).select("roster_id", "week", R.week_range(F.col("start_date")).alias("week_range"))


@query("row_id", f"""with ro as ({Q.roster()}) select roster_id, row_idx, case when row_idx % 3 = 0 then 'kept' else sha256(concat(roster_id, '-', row_idx)) end row_id from ro""")
def row_id(spark, sf):
    r = D.roster_synth(spark, sf).withColumn("row_id", F.when(F.col("row_idx") % 3 == 0, "kept").when(F.col("row_idx") % 3 == 1, " "))
    return O.row_id(r).select(*KEY, "row_id")


@query("csv_safe", r"""select doc_id, case when regexp_matches(text, '^[\t\r\n]*[=+\-@|]') then concat('''', text) else text end as text,
    case when doc_id % 4 = 0 then concat('''', chr(9), '=', lang) when doc_id % 4 = 1 then concat('''', '|', lang) else lang end lang from documents""")
def csv_safe(spark, sf):
    d = D.table(spark, sf, "documents")
    odd = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("\t="), "lang")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("|"), "lang")).otherwise(F.col("lang"))
    return X.csv_safe(d.select("doc_id", "text", odd.alias("lang")))


@query("scrub_ctrl", r"""select doc_id, regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g') as text,
    replace(regexp_replace(text[1:200], '[\x00-\x1f\x7f]', '', 'g'), '"', '''') term from documents""")
def scrub_ctrl(spark, sf):
    d = D.table(spark, sf, "documents")
    return d.select("doc_id", X.scrub_ctrl(F.col("text")).alias("text"), X.scrub_ctrl(F.col("text"), quotes=True, limit=200).alias("term"))


@query("shift_window_label", f"""with ro as ({Q.roster()}), c as (select unnest(codes) code from ro)
    select code, case when ({Q.START.format(c='code')}) is null then '—' else concat(lpad(cast({Q.START.format(c='code')} as varchar), 2, '0'), ':00–',
      lpad(cast(({Q.END.format(c='code')}) % 24 as varchar), 2, '0'), ':00') end as hours, count(*) n from c group by 1, 2""")
def shift_window_label(spark, sf):
    c = D.roster_synth(spark, sf).select(F.explode("codes").alias("code"))
    return c.withColumn("hours", R.shift_window_label(F.col("code"))).groupBy("code", "hours").agg(F.count(F.lit(1)).alias("n"))


@query("client_ip", """
    with q as (select event_id, case when event_id % 5 = 0 then '' when event_id % 2 = 0 then '10.0.0.1' else concat('192.168.0.', user_id % 200) end peer,
       case when event_id % 3 = 0 then concat(' 203.0.113.', user_id % 250, ' , 10.9.9.9') when event_id % 3 = 1 then '' end xff,
       case when event_id % 7 = 0 then '198.51.100.7' end xreal, case when event_id % 4 = 0 then '' else concat('u', user_id) end usr from events)
    select event_id, case when peer = '10.0.0.1' then coalesce(nullif(trim(split_part(xff, ',', 1)), ''), nullif(xreal, ''), peer)
      when peer = '' then '127.0.0.1' else peer end ip, case when usr = '' then 'anonymous' else usr end user_name from q""")
def client_ip(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    q = D.table(spark, sf, "events").select(
        "event_id", F.when(e % 5 == 0, "").when(e % 2 == 0, "10.0.0.1").otherwise(F.concat(F.lit("192.168.0."), (u % 200).cast("string"))).alias("peer"),
        F.when(e % 3 == 0, F.concat(F.lit(" 203.0.113."), (u % 250).cast("string"), F.lit(" , 10.9.9.9"))).when(e % 3 == 1, "").alias("xff"),
        F.when(e % 7 == 0, "198.51.100.7").alias("xreal"), F.when(e % 4 == 0, "").otherwise(F.concat(F.lit("u"), u.cast("string"))).alias("usr"))
    return q.select("event_id", X.client_ip(F.col("peer"), F.col("xff"), F.col("xreal"), ["10.0.0.1"]).alias("ip"), X.user_name(F.col("usr")).alias("user_name"))


# --- rules ---------------------------------------------------------------------------------------

RES = Q.results()


def _rule_query(key: str) -> None:
    def run(spark, sf):
        return _results(spark, sf, active=[key]).select(*KEY, F.col(f"ok_{key}").alias("passed"), F.col(f"msg_{key}").alias("message"))
    CATALOG[f"rule_{key}"] = (run, RES + f" select roster_id, row_idx, ok_{key} passed, msg_{key} message from f6")


for _key in dims.RULE_KEYS:
    _rule_query(_key)

MSG = ", ".join(f"msg_{k}" for k in dims.RULE_KEYS)


@query("validate", RES + f""" select roster_id, row_idx, matrix, {b('ot_a')}, {b('ot_b')}, {MSG}, pass "_pass", m_shift_gap gv, m_max_day dv,
    case when pass then 'Valid' else 'Invalid' end "Status" from f6""")
def validate(spark, sf):
    v = _results(spark, sf)
    return _big(v.select(*KEY, "matrix", "ot_a", "ot_b", *[f"msg_{k}" for k in dims.RULE_KEYS], "_pass", F.array_join("_gv", "; ").alias("gv"),
                         F.array_join("_dv", ", ").alias("dv"), "Status"), "ot_a", "ot_b")


@query("validate_events", Q.results(Q.roster_events()) + f""" select roster_id, row_idx, matrix, {MSG}, pass "_pass" from f6""")
def validate_events(spark, sf):
    return V.validate(D.roster_events(spark, sf)).select(*KEY, "matrix", *[f"msg_{k}" for k in dims.RULE_KEYS], "_pass")


@query("validate_thresholds", Q.results(max_week="44", min_week="50", roll="56", nw="8") + f""" select roster_id, row_idx, {MSG}, pass "_pass" from f6""")
def validate_thresholds(spark, sf):
    v = _results(spark, sf, policy={"max_week_hrs": 44, "min_week_hrs": 50, "max_rolling_7d_hrs": 56, "nw_credit_hrs": 8})
    return v.select(*KEY, *[f"msg_{k}" for k in dims.RULE_KEYS], "_pass")


ACTIVE = ["max_week", "valid_codes", "no_such_rule"]


@query("validate_active_subset", RES + """ select roster_id, row_idx, msg_max_week, msg_valid_codes, ok_max_week and ok_valid_codes "_pass" from f6""")
def validate_active_subset(spark, sf):
    return _results(spark, sf, active=ACTIVE).select(*KEY, "msg_max_week", "msg_valid_codes", "_pass")


POLICY_ROSTER = (POLICY_SQL + f", ro0 as ({Q.roster()}), rp as (select ro0.*, max_week_hrs, min_week_hrs, max_rolling_7d_hrs, nw_credit_hrs, active "
                 "from ro0 join pol on pol.k = cast(ro0.id_no as bigint) % (select count(*) from supplier))")
PER_ROW = Q.results("select * from rp", max_week="max_week_hrs", min_week="min_week_hrs", roll="max_rolling_7d_hrs", nw="nw_credit_hrs")
PER_ROW_SQL = POLICY_ROSTER + "," + PER_ROW.strip()[len("with"):]


def _n_policies(spark, sf) -> Column:
    return D.table(spark, sf, "supplier").select(F.count(F.lit(1))).scalar()


def _with_policy(spark, sf):
    r = D.roster_synth(spark, sf).withColumn(
        "policy_id", (F.col("id_no").cast("bigint") % _n_policies(spark, sf)).cast("string"))
    return V.policy_join(r, _policy(spark, sf))


@query("policy_join", PER_ROW_SQL + """ select roster_id, row_idx, msg_max_day, case when active = 'default' then msg_max_week end msg_max_week,
    case when active = 'default' then msg_min_week end msg_min_week, case when active = 'default' then pass else ok_max_day and ok_min_rd end "_pass" from f6""")
def policy_join(spark, sf):
    return V.validate(_with_policy(spark, sf)).select(*KEY, "msg_max_day", "msg_max_week", "msg_min_week", "_pass")


@query("active_rules", POLICY_SQL + f""" select policy_id, case when active = 'default' then '{','.join(dims.RULE_KEYS)}' else active end keys from pol""")
def active_rules(spark, sf):
    return _policy(spark, sf).select("policy_id", F.array_join(V.active_rules_column(F.col("active_rule_keys")), ",").alias("keys"))


# --- filters and search --------------------------------------------------------------------------

@query("search_roster", f"""with ro as ({Q.roster()}) select roster_id, row_idx, name from ro where contains(lower(name), '0077')
    or contains(lower(id_no), '0077') or contains(lower(station), '0077') or contains(lower(emp_status), '0077')""")
def search_roster(spark, sf):
    return O.search_roster(D.roster_synth(spark, sf), " 0077 ").select(*KEY, "name")


@query("search_results", RES + """ select roster_id, row_idx, "Status" from (select *, case when pass then 'Valid' else 'Invalid' end "Status",
    concat_ws(chr(10), name, station, emp_status, id_no, array_to_string(codes, chr(10)), """ + MSG + """) t from f6)
    where contains(lower(t), 'broken rest') """)
def search_results(spark, sf):
    return O.search_results(_results(spark, sf), "Broken REST").select(*KEY, "Status")


@query("violations_only", RES + " select roster_id, row_idx, name, msg_min_rd from f6 where not pass")
def violations_only(spark, sf):
    return O.violations_only(_results(spark, sf)).select(*KEY, "name", "msg_min_rd")


@query("week_view", RES + " select roster_id, row_idx, station, emp_status, id_no, name, " + ", ".join(
    f'codes[{i + 8}] "{d}"' for i, d in enumerate(dims.DAYS_B)) + f""", {b('ot_b')}, case when pass then 'Valid' else 'Invalid' end "Status" from f6""")
def week_view(spark, sf):
    return _big(O.week_view(_results(spark, sf), "B"), "ot_b")


@query("coverage_filter", PERIOD + f""", ro as ({Q.roster()}), lg as (select roster_id, d day_idx, case when d < 7 then 'A' else 'B' end as week, upper(trim(codes[d + 1])) code
      from ro, (select unnest(range(14)) d))
    select roster_id, {b('day_idx')}, code, count(*) n from lg join pe using (roster_id, week)
    where start_date is null or start_date + cast(day_idx % 7 as int) between date '2024-05-03' and date '2024-05-10' group by all""")
def coverage_filter(spark, sf):
    import datetime
    long = O.long_form(D.roster_synth(spark, sf), "roster_id")
    kept = O.coverage_filter(long, D.period(spark, sf), ["A", "B"], (datetime.date(2024, 5, 10), datetime.date(2024, 5, 3)))
    return _big(kept.groupBy("roster_id", "day_idx", "code").agg(F.count(F.lit(1)).alias("n")), "day_idx")


@query("merge_edits", f"""with ro as ({Q.roster()}), i as (select *, sha256(concat(roster_id, '-', row_idx)) row_id from ro)
    select row_id, name, case when row_idx % 10 = 0 then concat(station, ' edited') else station end station from i where row_idx % 10 <> 1
    union all select sha256(concat(roster_id, '-', row_idx + 100000)), name, 'added' from i where row_idx % 50 = 1""")
def merge_edits(spark, sf):
    base = O.row_id(D.roster_synth(spark, sf))
    shown = base.filter(F.col("row_idx") % 10 < 2)
    edited = shown.filter(F.col("row_idx") % 10 == 0).withColumn("station", F.concat("station", F.lit(" edited")))
    added = shown.filter(F.col("row_idx") % 50 == 1).withColumns(
        {"station": F.lit("added"), "row_id": F.lit(None).cast("string"), "row_idx": F.col("row_idx") + 100000})
    return O.merge_edits(base, shown, edited.unionByName(added)).select("row_id", "name", "station")


# --- reports -------------------------------------------------------------------------------------

@query("compliance_kpis", RES + f""" select count(*) total, count(*) filter (pass) valid, count(*) filter (not pass) invalid,
    {b('floor(100.0 * count(*) filter (pass) / count(*))', 'rate')}, {b('100 - floor(100.0 * count(*) filter (pass) / count(*))', 'gap')} from f6""")
def compliance_kpis(spark, sf):
    return A.compliance_kpis(_results(spark, sf))


@query("overtime_summary", RES + f""", t as (select count(*) n, sum(ot_a) a, sum(ot_b) b from f6) select n employees, {b('a', 'ot_a')}, {b('b', 'ot_b')}, {b('a + b', 'ot_total')},
    {Q.MEAN.format(n='a', d='n')} avg_ot_a, {Q.MEAN.format(n='b', d='n')} avg_ot_b, {Q.MEAN.format(n='(a + b)', d='n')} avg_ot from t""")
def overtime_summary(spark, sf):
    return A.overtime_summary(_results(spark, sf))


def _by_sql(col: str) -> str:
    return RES + f""", t as (select {col}, count(*) headcount, count(*) filter (pass) valid, cast(sum(ot_a + ot_b) as bigint) ot from f6 group by 1)
    select {col}, headcount, valid, headcount - valid invalid, {Q.tenths('valid', 'headcount')} compliance"""


@query("matrix_distribution", _by_sql("matrix") + " from t")
def matrix_distribution(spark, sf):
    return A.matrix_distribution(_results(spark, sf))


@query("coverage_by_station", _by_sql("station") + f""", ot, concat({Q.tenths('valid', 'headcount')}, ' · ', ot, 'h OT') compliance_ot from t""")
def coverage_by_station(spark, sf):
    return A.coverage_by_station(_results(spark, sf))


TOP = RES + ", t as (" + " union all ".join(
    f"select {i} ord, '{n}' as rule, count(*) filter (not ok_{k}) failed, count(*) total from f6" for i, (k, n) in enumerate(dims.RULES)) + ")"


@query("top_violations", TOP + f" select rule, failed, {Q.tenths('failed', 'total')} rate, {b('ord')} from t where failed > 0")
def top_violations(spark, sf):
    return _big(A.top_violations(_results(spark, sf)), "ord")


LONG = RES + f", lg as (select d, upper(trim(codes[d + 1])) code from f6, (select unnest(range(14)) d)), hc as (select d, code, count(*) n from lg where code <> '' group by all)"
CELLS = ", ".join(f'cast(coalesce(sum(n) filter (d = {i}), 0) as bigint) "{d}"' for i, d in enumerate(dims.DAYS))


@query("headcount_pivot", LONG + f" select code shift, {CELLS} from hc group by code union all select 'TOTAL', {CELLS} from hc")
def headcount_pivot(spark, sf):
    return A.headcount_pivot(D.roster_synth(spark, sf))


WINDOW_SQL = (f"case when ({Q.START.format(c='code')}) is null then '—' else concat(lpad(cast({Q.START.format(c='code')} as varchar), 2, '0'), ':00–', "
              f"lpad(cast(({Q.END.format(c='code')}) % 24 as varchar), 2, '0'), ':00') end")


@query("headcount_long", LONG + f" select {b('d', 'day_idx')}, {Q.DAY_LIST}[d + 1] as day, code shift, n headcount, {WINDOW_SQL} shift_hours from hc")
def headcount_long(spark, sf):
    return _big(A.headcount_long(D.roster_synth(spark, sf)), "day_idx")


@query("status_summary", RES + f""", t as (select emp_status, count(*) total, count(*) filter (pass) valid, cast(sum(ot_a + ot_b) as bigint) ot from f6 group by 1)
    select emp_status, total, valid, total - valid invalid, concat(cast(round_even(100.0 * valid / total, 0) as bigint), '%') pass_rate, ot from t""")
def status_summary(spark, sf):
    return A.status_summary(_results(spark, sf))


SUMMARY = RES + f""", t as (select count(*) n, count(*) filter (pass) v, cast(sum(ot_a) as bigint) a, cast(sum(ot_b) as bigint) b from f6),
    kp as (select unnest([{{'o': 0, 'm': 'Total Headcount', 'x': cast(n as varchar)}}, {{'o': 1, 'm': 'Valid Schedules', 'x': cast(v as varchar)}},
      {{'o': 2, 'm': 'Invalid Schedules', 'x': cast(n - v as varchar)}}, {{'o': 3, 'm': 'Compliance Rate', 'x': {Q.tenths('v', 'n')}}},
      {{'o': 4, 'm': 'Week A — Total OT Hours', 'x': concat(a, 'h')}}, {{'o': 5, 'm': 'Week B — Total OT Hours', 'x': concat(b, 'h')}},
      {{'o': 6, 'm': '14-Day Total OT Hours', 'x': concat(a + b, 'h')}},
      {{'o': 7, 'm': 'Average OT / Employee', 'x': concat(cast({Q.MEAN.format(n='(a + b)', d='n')} as varchar), 'h')}}]) s from t)"""


@query("summary_kpis", SUMMARY + f" select {b('s.o', 'ordinal')}, s.m metric, s.x \"value\" from kp")
def summary_kpis(spark, sf):
    return _big(A.summary_kpis(_results(spark, sf)), "ordinal")


@query("export_header", PERIOD + "," + RES.strip()[len("with"):] + f""", rg as (select roster_id, week, concat(label, case when start_date is null then '' else
    concat(' (', month({MONDAY}), '/', day({MONDAY}), ' – ', month({MONDAY} + 6), '/', day({MONDAY} + 6), ')') end) t from pe)
    select roster_id, max(t) filter (week = 'A') week_a, max(t) filter (week = 'B') week_b, any_value(e) employees, any_value(o) overtime from rg
    join (select roster_id, concat('Employees: ', count(*)) e, concat('Total OT: ', sum(ot_a + ot_b), 'h') o from f6 group by 1) using (roster_id) group by 1""")
def export_header(spark, sf):
    return A.export_header(_results(spark, sf), D.period(spark, sf))


@query("explode_violations", Q.violations() + f""" select roster_id, row_idx, {b('ord')}, id_no, name, station, matrix, "type", details from vio""")
def explode_violations(spark, sf):
    return _big(A.explode_violations(_results(spark, sf)), "ord")


@query("violation_type_counts", Q.violations() + """ select "type", count(distinct id_no) employees from vio group by 1
    order by 2 desc, list_position([""" + ",".join(f"'{n}'" for _, n in dims.RULES) + """], "type") limit 4""")
def violation_type_counts(spark, sf):
    return A.violation_type_counts(A.explode_violations(_results(spark, sf)))


CARD = ["roster_id", "id_no", "name", "station", "matrix", "details", "failed_weeks", "rules", "severity", "search_blob"]
CARD_SQL = ", ".join(CARD) + f", {b('row_idx')}, {b('n_violations')}, {b('structural')}"


def _cards(spark, sf):
    return A.group_violations(A.explode_violations(_results(spark, sf)))


def _shown(cards, *more):
    return _big(cards.select(*CARD, "row_idx", "n_violations", "structural", *more), "row_idx", "n_violations", "structural", *more)


@query("group_violations", Q.cards() + f" select {CARD_SQL} from cards")
def group_violations(spark, sf):
    return _shown(_cards(spark, sf))


HOT = f"select roster_id, row_idx, case when row_idx % 3 = 0 then 'Unspecified' else name end as name, station, emp_status, case when row_idx % 3 = 0 then '' else id_no end id_no, codes from ({Q.roster()})"


@query("group_violations_hot_key", Q.cards().replace(Q.roster(), HOT) + f" select {CARD_SQL} from cards")
def group_violations_hot_key(spark, sf):
    hot = F.col("row_idx") % 3 == 0
    r = D.roster_synth(spark, sf).withColumns({"name": F.when(hot, "Unspecified").otherwise(F.col("name")), "id_no": F.when(hot, "").otherwise(F.col("id_no"))})
    return _shown(A.group_violations(A.explode_violations(V.validate(r))))


@query("failed_weeks", Q.cards() + " select failed_weeks, severity, count(*) n from cards group by all")
def failed_weeks(spark, sf):
    return _cards(spark, sf).groupBy("failed_weeks", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("rank_violations", Q.cards() + f""" select {CARD_SQL}, row_number() over (partition by roster_id order by structural desc, n_violations desc, row_idx) rank from cards""")
def rank_violations(spark, sf):
    return _shown(A.rank_violations(_cards(spark, sf)), "rank")


@query("violation_search", Q.cards() + " select id_no, name, details from cards where contains(search_blob, 'cross-week')")
def violation_search(spark, sf):
    return A.violation_search(_cards(spark, sf), "Cross-Week").select("id_no", "name", "details")


@query("page_employees", RES + """, v as (select roster_id, row_idx, name, row_number() over (partition by roster_id order by row_idx) rn, count(*) over (partition by roster_id) n from f6 where not pass)
    select roster_id, row_idx, name from v where rn > (least(6, greatest(1, ceil(n / 50.0))) - 1) * 50 and rn <= least(6, greatest(1, ceil(n / 50.0))) * 50""")
def page_employees(spark, sf):
    bad = O.violations_only(_results(spark, sf)).select(*KEY, "name")
    return O.page(bad, 6, 50, ["roster_id"], "row_idx")


# --- logs ----------------------------------------------------------------------------------------

REC = Q.records()


def _records(spark, sf):
    return L.log_records(D.log_synth(spark, sf))


@query("redact_documents", f"select doc_id, {Q.redacted('text')} redacted from documents")
def redact_documents(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", X.redact(F.col("text")).alias("redacted"))


@query("redact_pii", f"select doc_id, {Q.redacted('text', True)} redacted from documents")
def redact_pii(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", X.redact(F.col("text"), mask_pii=True).alias("redacted"))


@query("redact_logs", LINES_SQL + f" select file, line_no, {Q.redacted('value')} redacted from lines")
def redact_logs(spark, sf):
    return D.log_synth(spark, sf).select("file", "line_no", X.redact(F.col("value")).alias("redacted"))


@query("parse_log", REC + " select file, line_no, ts, level, logger, trace_id, message, raw from rec")
def parse_log(spark, sf):
    return _records(spark, sf)


@query("parse_ts", REC + " select file, line_no, strftime(tsv, '%Y-%m-%d %H:%M:%S') ts from rect")
def parse_ts(spark, sf):
    return _records(spark, sf).select("file", "line_no", F.date_format(X.parse_ts(F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("coerce_level", REC + " select lv level, count(*) n from rect group by 1")
def coerce_level(spark, sf):
    return _records(spark, sf).groupBy(X.coerce_level(F.col("level")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("log_filter", REC + """ select file, line_no, level, raw from rect where (level = '' or level in ('ERROR', 'WARNING'))
    and tsv >= timestamp '2024-01-05 00:00:00' and tsv <= timestamp '2024-01-20 12:00:00' and contains(trace_id, 'sesh-1') and contains(lower(raw), 'event')""")
def log_filter(spark, sf):
    return L.log_filter(_records(spark, sf), levels=["error", "warning"], since="2024-01-05 00:00:00", until="2024-01-20 12:00:00",
                        trace_id="sesh-1", grep="EVENT").select("file", "line_no", "level", "raw")


@query("log_filter_regex", REC + " select file, line_no, raw from rec where regexp_matches(raw, '(?i)TRACEBACK line \\d+5$')")
def log_filter_regex(spark, sf):
    return L.log_filter(_records(spark, sf), grep=r"TRACEBACK line \d+5$", regex=True).select("file", "line_no", "raw")


@query("log_kpis", REC + " select count(*) lines, count(*) filter (level in ('ERROR', 'CRITICAL')) errors, count(*) filter (level = 'WARNING') warnings from rec")
def log_kpis(spark, sf):
    return L.log_kpis(_records(spark, sf))


@query("severity_histogram", REC + f""", ev as (select cast(epoch(tsv) as bigint) sec, lv from rect where tsv is not null), sp as (select min(sec) lo, max(sec) hi from ev),
    wd as (select min(w) w from (select unnest({L.BIN_SECONDS}) w), sp where hi // w - lo // w + 1 <= 60)
    select {b('sec // w * w', 'bin_start')}, {b('w', 'width')}, lv level, count(*) events from ev, wd group by all""")
def severity_histogram(spark, sf):
    return L.severity_histogram(_records(spark, sf))


@query("tail", LINES_SQL + """, t as (select *, row_number() over (partition by file order by line_no desc) rn from lines),
    t2 as (select *, sum(strlen(value) + 1) over (partition by file order by line_no desc rows unbounded preceding) by_ from t where rn <= 100)
    select file, line_no, value from t2 where by_ < 8000 or (line_no = 1 and by_ <= 8000)""")
def tail(spark, sf):
    return L.tail(D.log_synth(spark, sf), 100, 8000)


FEED = Q.feed()


def _changes(spark, sf):
    return L.log_records(D.change_synth(spark, sf))


def _feed(spark, sf, **kw):
    return L.change_feed(_changes(spark, sf), **kw)


@query("parse_audit", FEED + " select file, line_no, action, case when user_id = '' then 'unknown' else user_id end user_id, error, th thresholds, ak active_rule_keys from c0")
def parse_audit(spark, sf):
    return L.parse_audit(_changes(spark, sf)).select("file", "line_no", "action", "user_id", "error", "thresholds", "active_rule_keys")


@query("audit_pairs", LINES_SQL + """ select file, line_no, regexp_extract(value, 'ip="([^"]*)"', 1) ip, regexp_extract(value, 'user_agent="([^"]*)"', 1) agent,
    cast(len(regexp_extract_all(value, '(\\w+)="([^"]*)"')) as bigint) n from lines where contains(value, '| AUDIT |')""")
def audit_pairs(spark, sf):
    lines = D.log_synth(spark, sf).filter(F.col("value").contains("| AUDIT |")).withColumn("m", X.audit_pairs(F.col("value")))
    return lines.select("file", "line_no", F.try_element_at("m", F.lit("ip")).alias("ip"), F.try_element_at("m", F.lit("user_agent")).alias("agent"),
                        F.size("m").cast("bigint").alias("n"))


@query("python_literal", FEED + f""" select file, line_no, coalesce(array_to_string(ks, ','), 'null') keys, {b("len(ks)", 'n')} from c1 where sv""")
def python_literal(spark, sf):
    a = L.parse_audit(_changes(spark, sf)).filter("action = 'admin_defaults_saved'")
    keys = X.python_literal(F.translate(F.col("active_rule_keys"), '"', "'"), "array<string>")
    return a.select("file", "line_no", F.coalesce(F.array_join(keys, ","), F.lit("null")).alias("keys"),
                    F.when(keys.isNotNull(), F.size(keys)).cast("bigint").alias("n"))


NAMES = "list_transform(ks, lambda k: case k " + " ".join(f"when '{k}' then '{n}'" for k, n in dims.RULES) + " else k end)"


@query("rule_names", FEED + f" select file, line_no, array_to_string({NAMES}, ', ') names from c1 where ks is not null")
def rule_names(spark, sf):
    a = L.parse_audit(_changes(spark, sf)).withColumn("k", X.python_literal(F.col("active_rule_keys"), "array<string>")).filter("k is not null")
    return a.select("file", "line_no", F.array_join(X.rule_names(F.col("k")), ", ").alias("names"))


@query("change_feed", FEED + " select * from feed")
def change_feed(spark, sf):
    return _feed(spark, sf)


@query("summarize_save", FEED + " select summary, detail, count(*) n from feed where action = 'admin_defaults_saved' group by all")
def summarize_save(spark, sf):
    return _feed(spark, sf, action="admin_defaults_saved").groupBy("summary", "detail").agg(F.count(F.lit(1)).alias("n"))


@query("change_feed_across_archives", FEED.replace("partition by file order by line_no", "order by file, line_no").replace(
    "max(case when sv or rs then line_no end)", "max(case when sv or rs then concat(file, '#', lpad(cast(line_no as varchar), 9, '0')) end)").replace(
    "a.file = b.file and a.pl = b.line_no", "a.pl = concat(b.file, '#', lpad(cast(b.line_no as varchar), 9, '0'))") + " select * from feed")
def change_feed_across_archives(spark, sf):
    return _feed(spark, sf, across_archives=True)


@query("feed_search", FEED + """ select file, line_no, summary from feed where contains(lower(summary), 'unpinned') or contains(lower(detail), 'unpinned')
    or contains(lower(user_id), 'unpinned') or contains(lower(action), 'unpinned')""")
def feed_search(spark, sf):
    return L.feed_search(_feed(spark, sf), "Unpinned").select("file", "line_no", "summary")


@query("change_kpis", FEED + """ select count(*) changes, count(*) filter (action = 'admin_defaults_saved') saves, count(*) filter (action = 'admin_defaults_reset_to_factory') resets,
    count(*) filter (suffix(action, '_failed')) failures, arg_max(ts, concat(file, lpad(cast(line_no as varchar), 9, '0'))) latest from feed""")
def change_kpis(spark, sf):
    return L.change_kpis(_feed(spark, sf))


@query("threshold_change_log", """with s as (select user_id, event_id, event_type setting, event_id % 3 as "value" from events),
    l as (select *, lag("value") over (partition by user_id, setting order by event_id) old_value from s)
    select user_id, event_id, setting, "value", old_value from l where old_value is not null and old_value <> "value" """)
def threshold_change_log(spark, sf):
    s = D.table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("setting"), (F.col("event_id") % 3).alias("value"))
    return L.threshold_change_log(s, ["user_id"], "event_id")


@query("format_kv", """select event_id, concat('action="', event_type, '" user_id="user', user_id, '" ip="10.0.0.1" user_agent="ua" file="', replace(regexp_replace(props, '[\\x00-\\x1f\\x7f]', '', 'g'), '"', ''''),
    '" count="', user_id % 7, '"') line from events""")
def format_kv(spark, sf):
    e = D.table(spark, sf, "events")
    line = X.format_kv(F.col("event_type"), F.concat(F.lit("user"), F.col("user_id").cast("string")), F.lit("10.0.0.1"), F.lit("ua"),
                       {"file": F.col("props"), "count": F.col("user_id") % 7})
    return e.select("event_id", line.alias("line"))


# --- time-based operators ------------------------------------------------------------------------

DAY = 86_400


LIMITED = """
    with recursive e as (select event_id, user_id, epoch_us(ts) us, row_number() over (partition by user_id order by epoch_us(ts), event_id) rn from events),
    w as (select event_id, user_id, us, rn, true allowed, cast(0 as bigint) retry_after, [us] held from e where rn = 1
      union all
      select event_id, user_id, us, rn, len(k) < 2, cast(case when len(k) < 2 then 0 else greatest((86400000000 - (us - k[1])) // 1000000, 1) end as bigint),
        case when len(k) < 2 then list_append(k, us) else k end
      from (select e.event_id, e.user_id, e.us, e.rn, list_filter(w.held, lambda t: e.us - t < 86400000000) k
            from w join e on e.user_id = w.user_id and e.rn = w.rn + 1) n)"""


@query("rate_limit", LIMITED + " select event_id, user_id, allowed, retry_after from w")
def rate_limit(spark, sf):
    e = D.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return TL.rate_limit(e, "user_id", "ts", "event_id", limit=2, window=DAY).select("event_id", "user_id", "allowed", "retry_after")


@query("attempt_rate", """select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 86399999999 preceding and current row) attempts from events""")
def attempt_rate(spark, sf):
    return TL.attempt_rate(D.table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", DAY).select("event_id", "attempts")


SESSIONS = """with e as (select user_id, epoch_us(ts) us from events), l as (select *, us - lag(us) over (partition by user_id order by us) gap from e),
    s as (select *, 1 + coalesce(sum(case when gap > 43200000000 then 1 else 0 end) over (partition by user_id order by us), 0) session_no from l)
    select user_id, cast(session_no as bigint) session_no, min(us) start_us, max(us) end_us, count(*) events from s group by 1, 2"""


@query("idle_sessions", SESSIONS)
def idle_sessions(spark, sf):
    return TS.idle_sessions(D.table(spark, sf, "events"), "user_id", "ts", 43_200)


def _event_stream(spark, sf):
    schema = D.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")


# Drained: what is still open at the end of the input is there too.
LAST = "2200-01-01 00:00:00"


@query("stream_rate_limit", LIMITED + " select event_id, user_id, allowed, retry_after from w")
def stream_rate_limit(spark, sf):
    e = _event_stream(spark, sf).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"))
    limited = lambda x: TL.rate_limit_stream(x.withWatermark("at", "1 hour"), "user_id", "at", "event_id", 2, DAY)
    return TV.drain_to_table(e, limited, {"at": LAST}, "rate-limit").select("event_id", "user_id", "allowed", "retry_after")


def _event_lines(spark, sf):
    e = _event_stream(spark, sf)
    line = F.concat(F.substring(F.col("ts").cast("string"), 1, 19), F.lit(" | "), F.rpad(D._level(), 8, " "), F.lit(" | app.main | trace_id=sesh-"),
                    F.col("user_id").cast("string"), F.lit(" | event "), F.col("event_type"))
    return e.select(F.lit("app.log").alias("file"), F.col("event_id").alias("line_no"), line.alias("value"))


@query("stream_idle_sessions", f"select user_id, start_us, end_us, events from ({SESSIONS}) t")
@query("stream_idle_sessions_drained", f"select user_id, start_us, end_us, events from ({SESSIONS}) t")
def stream_idle_sessions(spark, sf):
    e = _event_stream(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    return TV.drain_to_table(e, lambda x: TS.idle_sessions_stream(x, "user_id", "at", 43_200), {"at": LAST}, "sessions")


@query("stream_log_severity", f"""with e as (select epoch_us(ts) // 1000000 sec, {Q.LEVEL} level from events), g as (select sec // 3600 * 3600 s, level, count(*) n from e group by all)
    select {b('s', 'bin_sec')}, level, n events from g""")
def stream_log_severity(spark, sf):
    last = f"{LAST} | INFO     | app.main | trace_id=sesh-0 | end"
    done = TV.drain_to_table(_event_lines(spark, sf), lambda x: TV.live_log_severity(x, "1 hour"), {"file": "app.log", "value": last}, "severity")
    return done.select(F.unix_seconds("bin_start").alias("bin_sec"), "level", "events")


@query("stream_validate", RES + """ select roster_id, row_idx, matrix, case when pass then 'Valid' else 'Invalid' end "Status" from f6""")
def stream_validate(spark, sf):
    schema = D.table(spark, sf, "customer").schema
    rosters = D.roster_from_customers(spark.readStream.schema(schema).parquet(f"{sf}/custome[r].parquet"))
    return TV.run_to_table(TV.stream_validate(rosters).select(*KEY, "matrix", "Status"), "validated")


@query("stream_ingest_files", FILES + f"""
    , v as ({Q.results()} select * from f6)
    select file, {b('row_idx')}, "Status", reason from (
      select file, k - (select min(k) from k k2 where k2.n = fl.n) + 2 row_idx, case when v.pass then 'Valid' else 'Invalid' end "Status", cast(null as varchar) reason
      from k join fl using (n) join v on v.id_no = k.id_no where bad is null and not headless and k % 40 not in (3, 5)
      union all select file, null, null, coalesce(bad, 'No 14-day schedule columns found. Ensure ''Mon''–''Sun'' appear twice in your header row.') from fl
      where bad is not null or headless) t""")
def stream_ingest_files(spark, sf):
    """Two arrivals with a restart between them; both tables."""
    folder, out = shared_dir(spark, "arriving"), shared_dir(spark, "ingested")
    for half in (0, 1):
        D.grid_folder(spark, sf, folder, F.col("n") % 2 == half)
        accepted, rejected = TA.ingest_files(spark, folder, out, name=D.FILE_NAME, files_per_batch=100)
    good = accepted.select(F.col("roster_id").alias("file"), F.col("row_idx").cast("bigint").alias("row_idx"), "Status", F.lit(None).cast("string").alias("reason"))
    bad = rejected.select("file", F.lit(None).cast("bigint").alias("row_idx"), F.lit(None).cast("string").alias("Status"), "reason")
    return good.unionByName(bad)


# --- calendars -----------------------------------------------------------------------------------

def _edge(part: int) -> str:
    return "case code " + " ".join(f"when '{c}' then {v[part]}" for c, v in dims.SHIFTS.items() if v[part] is not None) + " end"


@query("timeline_violations", f"""
    with ro as ({Q.roster_events()}), x as (select id_no employee, date '2024-01-01' + cast(14 * (roster_id % 100000) as int) period, codes, unnest(range(14)) d from ro),
    days as (select employee, period, period + cast(d as int) dt, codes[d + 1] code, {Q.HOURS.format(c='codes[d + 1]')} h from x),
    r as (select *, sum(h) over w s, min(period) over w <> max(period) over w crosses from days
          window w as (partition by employee order by dt range between interval 6 day preceding and current row)),
    ri as (select *, dt - cast(row_number() over (partition by employee order by dt) as int) island from r where s > 40),
    c as (select *, dt - cast(row_number() over (partition by employee order by dt) as int) island from days where h > 0),
    g as (select *, {_edge(1)} b, lag({_edge(2)}) over o pe, lag(dt) over o pd, lag(period) over o pp from days window o as (partition by employee order by dt))
    select employee, 'max_rolling_7d' "rule", cast(min(dt) - 6 as varchar) from_date, cast(max(dt) as varchar) to_date, cast(max(s) as bigint) "value", bool_and(crosses) crosses
      from ri group by employee, island
    union all select employee, 'max_consecutive', cast(min(dt) as varchar), cast(max(dt) as varchar), count(*), min(period) <> max(period) from c group by employee, island having count(*) > 4
    union all select employee, 'shift_gap', cast(pd as varchar), cast(dt as varchar), cast(24 + b - pe as bigint), period <> pp from g where dt - pd = 1 and 24 + b - pe < 8""")
def timeline_violations(spark, sf):
    start = F.date_add(F.lit("2024-01-01").cast("date"), (14 * (F.col("roster_id") % D.PERIODS)).cast("int"))
    days = TI.day_rows(D.roster_events(spark, sf), F.col("id_no"), start)
    return TI.timeline_violations(days, 40, 4).withColumns({c: F.col(c).cast("string") for c in ("from_date", "to_date")})


# --- sinks ---------------------------------------------------------------------------------------

CLEAN = "[" + ",".join(f"'{c}'" for c in D.PATTERNS[0].split()) + "]"
ONE_ROSTER = f"""select roster_id, row_idx, name, station, emp_status, id_no,
    case when roster_id % 2 = 0 then {CLEAN} else codes end codes from ({Q.roster()})"""


def _half_clean(spark, sf):
    clean = F.array(*[F.lit(c) for c in D.PATTERNS[0].split()])
    return V.validate(D.roster_synth(spark, sf).withColumn("codes", F.when(F.col("roster_id") % 2 == 0, clean).otherwise(F.col("codes"))))


@query("export_gate", Q.results(ONE_ROSTER) + """ select roster_id, row_idx, name from f6 where roster_id in
    (select roster_id from f6 group by 1 having floor(100.0 * count(*) filter (pass) / count(*)) = 100)""")
def export_gate(spark, sf):
    return A.export_gate(_half_clean(spark, sf)).select(*KEY, "name")


@query("export_schedule", f"with ro as ({Q.roster()}) select roster_id, row_idx, station, emp_status, id_no, name, '' \"SPACER\", " + ", ".join(
    f'codes[{i + 1}] "{d}"' for i, d in enumerate(dims.DAYS)) + " from ro")
def export_schedule(spark, sf):
    return K.schedule_frame(_results(spark, sf))


@query("export_details", RES + ' select roster_id, row_idx, station "Station", emp_status "EMP. STATUS", id_no "ID No.", name as "Name", ' + ", ".join(
    f'msg_{k} "{n}"' for k, n in dims.RULES) + f""", {b('ot_a', '"OT Hrs A"')}, {b('ot_b', '"OT Hrs B"')}, {b('ot_a + ot_b', '"OT Hrs Total"')}, case when pass then 'Valid' else 'Invalid' end "Status" from f6""")
def export_details(spark, sf):
    return _big(K.details_frame(_results(spark, sf)), "OT Hrs A", "OT Hrs B", "OT Hrs Total")


CODE_RANK = "coalesce(list_position([" + ",".join(f"'{c}'" for c in dims.WORK_ORDER + dims.REST_ORDER) + "], code), 99)"


@query("export_summary", SUMMARY + TOP[len(RES):].replace(", t as (", ", tv as (", 1) + LONG[len(RES):] + f""",
    tm as (select matrix, count(*) headcount, count(*) filter (pass) valid from f6 group by 1),
    ts as (select station, count(*) headcount, count(*) filter (pass) valid, cast(sum(ot_a + ot_b) as bigint) ot from f6 group by 1)
    select 'kpi' section, {b('s.o + 1', 'ordinal')}, s.m c1, s.x c2, '' c3, '' c4 from kp
    union all select 'matrix', row_number() over (order by headcount desc, matrix), matrix, cast(headcount as varchar), cast(valid as varchar), {Q.tenths('valid', 'headcount')} from tm
    union all select 'station', row_number() over (order by headcount desc, station), station, cast(headcount as varchar), cast(valid as varchar), concat({Q.tenths('valid', 'headcount')}, ' · ', ot, 'h OT') from ts
    union all select 'violations', row_number() over (order by failed desc, ord), rule, cast(failed as varchar), {Q.tenths('failed', 'total')}, '' from tv where failed > 0
    union all select 'headcount', row_number() over (order by d, {CODE_RANK}, code), concat({Q.DAY_LIST}[d + 1][1:3], ' Week ', {Q.DAY_LIST}[d + 1][5:5]), code, cast(n as varchar), {WINDOW_SQL} from hc""")
def export_summary(spark, sf):
    return A.export_summary(_results(spark, sf))


def _csv_files(spark, path):
    """(file, row_idx, cells) of exported files, read as uploads are."""
    return G.records(G.read_text(spark, path))


ROSTER_OF = "cast(regexp_extract(file, '/roster_id=([0-9]+)/', 1) as bigint)"


@query("export_schedule_files", PERIOD + f""", ro as ({Q.roster()}), st as (select roster_id, max(start_date) filter (week = 'A') a, max(start_date) filter (week = 'B') b from pe group by 1),
    h as (select roster_id, list_concat(['Station/Designation', 'Employee Status', 'ID NO.', 'Operator''s Name:'],
      list_transform(range(7), lambda i: case when a is null then {dims.WEEKDAYS}[i + 1] else concat({dims.WEEKDAYS}[i + 1], chr(10), month(cast(date_trunc('week', a) as date) + cast(i as int)), '/', day(cast(date_trunc('week', a) as date) + cast(i as int))) end), ['SPACER'],
      list_transform(range(7), lambda i: case when b is null then {dims.WEEKDAYS}[i + 1] else concat({dims.WEEKDAYS}[i + 1], chr(10), month(cast(date_trunc('week', b) as date) + cast(i as int)), '/', day(cast(date_trunc('week', b) as date) + cast(i as int))) end)) cells from st)
    select roster_id, array_to_string(cells, '|') line from h
    union all select roster_id, array_to_string(list_concat([station, emp_status, id_no, name], codes[1:7], [''], codes[8:14]), '|') from ro""")
def export_schedule_files(spark, sf):
    """What the writer puts into files, read back; one header line for each roster."""
    path = shared_dir(spark, "schedule")
    K.export_schedule(_results(spark, sf), path, D.period(spark, sf))
    return _csv_files(spark, path).select(F.expr(ROSTER_OF).alias("roster_id"), F.array_join("cells", "|").alias("line"))


@query("export_details_files", RES + ' select roster_id, station "Station", name as "Name", msg_max_day "Daily Hours Check", msg_shift_gap "Mandatory Shift Gap", '
       + """cast(ot_a + ot_b as varchar) "OT Hrs Total", case when pass then 'Valid' else 'Invalid' end "Status" from f6""")
def export_details_files(spark, sf):
    path = shared_dir(spark, "details")
    K.export_details(_results(spark, sf), path)
    read = spark.read.option("header", True).option("escape", '"').csv(path)
    return read.select(F.col("roster_id").cast("bigint").alias("roster_id"), "Station", "Name", "Daily Hours Check", "Mandatory Shift Gap", "OT Hrs Total", "Status")


@query("export_logs_files", REC + " select raw from rec")
def export_logs_files(spark, sf):
    path = shared_dir(spark, "log-export")
    K.export_logs(_records(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("raw"))


@query("export_changes_files", FEED + ' select ts "timestamp", user_id, action, summary, detail from feed')
def export_changes_files(spark, sf):
    path = shared_dir(spark, "change-export")
    K.export_changes(_feed(spark, sf), path)
    read = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return read.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("timestamp", "user_id", "action", "summary", "detail")])


@query("week_label", f"""select {b('roster_id')}, week, concat(label, case when start_date is null then '' else concat(' (', month({MONDAY}), '/', day({MONDAY}), ' – ', month({MONDAY} + 6), '/', day({MONDAY} + 6), ')') end) label
    from ({PERIOD} select * from pe) t""")
def week_label(spark, sf):
    p = D.period(spark, sf)
    return p.select(F.col("roster_id").cast("bigint").alias("roster_id"), "week", F.concat(
        R.week_label(F.col("week"), F.lit("Week A"), F.lit("Week B")), R.week_range(F.col("start_date"))).alias("label"))


@query("check_documents", """select cast(s_suppkey as varchar) policy_id, case s_suppkey % 5 when 2 then 'thresholds must be a dict' when 3 then 'not a JSON document'
    else 'thresholds must contain exactly these keys: [''max_rolling_7d_hrs'', ''max_week_hrs'', ''min_week_hrs'', ''nw_credit_hrs'']' end error from supplier""")
def check_documents(spark, sf):
    return SP.check_documents(D.policy_docs(spark, sf))


NAMED = f"select * from ({Q.roster()}) where cast(id_no as bigint) % 7 <> 0"


@query("run_metrics", Q.results(NAMED) + ", m as (select count(*) e, count(*) filter (pass) p, sum(ot_a + ot_b) o, " + ", ".join(
    f"count(*) filter (not ok_{k}) x_{k}" for k in dims.RULE_KEYS) + f""" from f6), c as (select count(*) n from customer)
    select 'rows' metric, n as "value" from c union all select 'blank_names', n - e from c, m union all select 'employees', e from m union all select 'odd_lengths', 0
    union all select 'passed', p from m union all select 'pass_rate', {b('floor(100.0 * p / e)', 'r')} from m union all select 'overtime_hours', {b('o')} from m union all """ + " union all ".join(
    f"select 'failed_{k}', x_{k} from m" for k in dims.RULE_KEYS))
def run_metrics(spark, sf):
    """What one run into a table observed; every seventh name is blank."""
    r = D.roster_synth(spark, sf)
    return A.run_metrics(r.withColumn("name", F.when(F.col("id_no").cast("bigint") % 7 != 0, F.col("name")).otherwise("")), shared_dir(spark, "validated"))


HEADS = "roster_id, id_no, name, station, matrix, row_idx, rules, n_violations, structural, severity, failed_weeks"


def _heads(cards):
    return _big(cards.select(*HEADS.split(", ")), "row_idx", "n_violations", "structural")


@query("violation_cards", Q.cards() + f" select roster_id, id_no, name, station, matrix, {b('row_idx')}, rules, n_violations, structural, severity, failed_weeks from cards")
def violation_cards(spark, sf):
    return _heads(A.violation_cards(A.explode_violations(_results(spark, sf))))


@query("violation_cards_hot_key", Q.cards().replace(Q.roster(), HOT) + f" select roster_id, id_no, name, station, matrix, {b('row_idx')}, rules, n_violations, structural, severity, failed_weeks from cards")
def violation_cards_hot_key(spark, sf):
    hot = F.col("row_idx") % 3 == 0
    r = D.roster_synth(spark, sf).withColumns({"name": F.when(hot, "Unspecified").otherwise(F.col("name")), "id_no": F.when(hot, "").otherwise(F.col("id_no"))})
    return _heads(A.violation_cards(A.explode_violations(V.validate(r))))


@query("card_page", Q.cards() + """, r as (select *, row_number() over (partition by roster_id order by structural desc, n_violations desc, row_idx, id_no, name) rank from cards)
    select roster_id, id_no, name, rank, details from r where rank between 26 and 50""")
def card_page(spark, sf):
    v = A.explode_violations(_results(spark, sf))
    return A.card_page(A.rank_violations(A.violation_cards(v)), v, 2).select("roster_id", "id_no", "name", F.col("rank").cast("bigint").alias("rank"), "details")


@query("search_cards", Q.cards() + " select roster_id, id_no, name from cards where contains(search_blob, 'cross-week')")
def search_cards(spark, sf):
    v = A.explode_violations(_results(spark, sf))
    return A.search_cards(A.violation_cards(v), v, "Cross-Week").select("roster_id", "id_no", "name")


# One report for each roster.
PER = "roster_id"
BY_ROSTER = RES + f""", t as (select roster_id, count(*) n, count(*) filter (pass) v, cast(sum(ot_a) as bigint) a, cast(sum(ot_b) as bigint) b from f6 group by 1),
    tv as (""" + " union all ".join(f"select roster_id, {i} ord, '{n}' as rule, count(*) filter (not ok_{k}) failed, count(*) total from f6 group by 1"
                                     for i, (k, n) in enumerate(dims.RULES)) + f"""),
    tm as (select roster_id, matrix, count(*) headcount, count(*) filter (pass) valid from f6 group by 1, 2),
    ts as (select roster_id, station, count(*) headcount, count(*) filter (pass) valid, cast(sum(ot_a + ot_b) as bigint) ot from f6 group by 1, 2),
    lg as (select roster_id, d, upper(trim(codes[d + 1])) code from f6, (select unnest(range(14)) d)),
    hc as (select roster_id, d, code, count(*) n from lg where code <> '' group by all)"""


@query("export_summary_by_roster", BY_ROSTER + f"""
    select roster_id, 'kpi' section, {b('o', 'ordinal')}, m c1, x c2, '' c3, '' c4 from (
      select roster_id, 1 o, 'Total Headcount' m, cast(n as varchar) x from t union all select roster_id, 2, 'Valid Schedules', cast(v as varchar) from t
      union all select roster_id, 3, 'Invalid Schedules', cast(n - v as varchar) from t union all select roster_id, 4, 'Compliance Rate', {Q.tenths('v', 'n')} from t
      union all select roster_id, 5, 'Week A — Total OT Hours', concat(a, 'h') from t union all select roster_id, 6, 'Week B — Total OT Hours', concat(b, 'h') from t
      union all select roster_id, 7, '14-Day Total OT Hours', concat(a + b, 'h') from t
      union all select roster_id, 8, 'Average OT / Employee', concat(cast({Q.MEAN.format(n='(a + b)', d='n')} as varchar), 'h') from t) k
    union all select roster_id, 'matrix', row_number() over (partition by roster_id order by headcount desc, matrix), matrix, cast(headcount as varchar), cast(valid as varchar), {Q.tenths('valid', 'headcount')} from tm
    union all select roster_id, 'station', row_number() over (partition by roster_id order by headcount desc, station), station, cast(headcount as varchar), cast(valid as varchar), concat({Q.tenths('valid', 'headcount')}, ' · ', ot, 'h OT') from ts
    union all select roster_id, 'violations', row_number() over (partition by roster_id order by failed desc, ord), rule, cast(failed as varchar), {Q.tenths('failed', 'total')}, '' from tv where failed > 0
    union all select roster_id, 'violations', 1, 'All employees pass every active rule.', '', '', '' from t where n = v
    union all select roster_id, 'headcount', row_number() over (partition by roster_id order by d, {CODE_RANK}, code), concat({Q.DAY_LIST}[d + 1][1:3], ' Week ', {Q.DAY_LIST}[d + 1][5:5]), code, cast(n as varchar), {WINDOW_SQL} from hc""")
def export_summary_by_roster(spark, sf):
    return A.export_summary(_results(spark, sf), by=(PER,))


@query("coverage_by_roster", BY_ROSTER + f""" select roster_id, 'matrix' kind, matrix as "value", headcount, valid, headcount - valid invalid, {Q.tenths('valid', 'headcount')} compliance from tm
    union all select roster_id, 'station', station, headcount, valid, headcount - valid, concat({Q.tenths('valid', 'headcount')}, ' · ', ot, 'h OT') from ts""")
def coverage_by_roster(spark, sf):
    r = _results(spark, sf)
    shown = [PER, "kind", "value", "headcount", "valid", "invalid", "compliance"]
    matrix = A.matrix_distribution(r, (PER,)).withColumns({"kind": F.lit("matrix"), "value": F.col("matrix")})
    station = A.coverage_by_station(r, (PER,)).withColumns({"kind": F.lit("station"), "value": F.col("station"), "compliance": F.col("compliance_ot")})
    return matrix.select(*shown).unionByName(station.select(*shown))


@query("overtime_by_roster", BY_ROSTER + f""" select roster_id, n employees, a ot_a, b ot_b, a + b ot_total,
    {Q.MEAN.format(n='a', d='n')} avg_ot_a, {Q.MEAN.format(n='b', d='n')} avg_ot_b, {Q.MEAN.format(n='(a + b)', d='n')} avg_ot from t""")
def overtime_by_roster(spark, sf):
    return A.overtime_summary(_results(spark, sf), by=(PER,))


@query("status_by_roster", RES + f""", t as (select roster_id, emp_status, count(*) total, count(*) filter (pass) valid, cast(sum(ot_a + ot_b) as bigint) ot from f6 group by 1, 2)
    select roster_id, emp_status, total, valid, total - valid invalid, concat(cast(round_even(100.0 * valid / total, 0) as bigint), '%') pass_rate, ot from t""")
def status_by_roster(spark, sf):
    return A.status_summary(_results(spark, sf), (PER,))


@query("headcount_by_roster", BY_ROSTER + f" select roster_id, code shift, {CELLS} from hc group by 1, 2 union all select roster_id, 'TOTAL', {CELLS} from hc group by 1")
def headcount_by_roster(spark, sf):
    return A.headcount_pivot(D.roster_synth(spark, sf), by=(PER,))


@query("top_violations_by_roster", BY_ROSTER + f" select roster_id, rule, failed, {Q.tenths('failed', 'total')} rate, {b('ord')} from tv where failed > 0")
def top_violations_by_roster(spark, sf):
    return _big(A.top_violations(_results(spark, sf), (PER,)), "ord")


@query("violation_types_by_roster", Q.violations() + f""", c as (select roster_id, type, count(distinct coalesce(nullif(id_no, ''), name)) employees from vio group by 1, 2)
    select roster_id, type, employees from c qualify row_number() over (partition by roster_id order by employees desc,
      list_position([{', '.join(f"'{n}'" for _, n in dims.RULES)}], type)) <= 4""")
def violation_types_by_roster(spark, sf):
    return A.violation_type_counts(A.explode_violations(_results(spark, sf)), by=(PER,))


@query("export_logs", REC + " select file, line_no, raw from rec")
def export_logs(spark, sf):
    return _records(spark, sf).select("file", "line_no", "raw")


@query("export_changes", FEED + ' select file, line_no, ts "timestamp", user_id, action, summary, detail from feed')
def export_changes(spark, sf):
    return K.changes_frame(_feed(spark, sf))


@query("observe_metrics", RES + " select roster_id, row_idx, pass \"_pass\" from f6")
def observe_metrics(spark, sf):
    observed, _ = A.observe_metrics(_results(spark, sf), "validation")
    return observed.select(*KEY, "_pass")
