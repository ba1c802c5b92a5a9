"""The registered queries once more as plain SQL for DuckDB, written independently of the operators."""

from __future__ import annotations

from shiftledger.plans import fixtures

DAYS = [f"{d}_{w}" for w in "AB" for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")]
DAY_LIST = "[" + ",".join(f"'{d}'" for d in DAYS) + "]"
LONG, SHORT = "('AOT','BOT','COT')", "('A','B','C','OS5')"
REST, EXTRA, CRED = "('RD','LEAVE','RH','SPH','NW')", "('LEAVE','RH','SPH','NW')", "('LEAVE','RH','SPH')"
VALID = "('','A','B','C','RD','AOT','BOT','COT','LEAVE','OS5','AWOL','NW','RH','SPH')"
HOURS = "case {c} when 'A' then 8 when 'B' then 8 when 'C' then 8 when 'AOT' then 12 when 'BOT' then 12 when 'COT' then 12 when 'OS5' then 9 else 0 end"
START = "case {c} when 'A' then 6 when 'B' then 14 when 'C' then 22 when 'AOT' then 6 when 'BOT' then 10 when 'COT' then 18 when 'OS5' then 8 end"
END = "case {c} when 'A' then 14 when 'B' then 22 when 'C' then 30 when 'AOT' then 18 when 'BOT' then 22 when 'COT' then 30 when 'OS5' then 17 end"
RULES = [
    ("max_day", "Daily Hours Check"), ("max_week", "Maximum Weekly Hours"),
    ("max_rolling_7d", "Max Rolling 7-Day Hours"), ("min_week", "Minimum Weekly Hours"),
    ("max_consecutive", "Consecutive Work Days"), ("valid_codes", "Valid Shift Codes"),
    ("min_rd", "Minimum Rest Days"), ("broken_rd", "Consecutive Rest Days"),
    ("shift_gap", "Mandatory Shift Gap"), ("holiday_pay", "Holiday Pay Flag"),
]


def roster() -> str:
    pats = "[" + ",".join("[" + ",".join(f"'{c}'" for c in p.split()) + "]" for p in fixtures.PATTERNS) + "]"
    over = "[" + ",".join(f"'{c}'" for c in fixtures.OVERRIDES) + "]"
    return f"""
    select c_custkey // 500 roster_id, cast(c_custkey % 500 as int) row_idx, c_name as name, c_mktsegment station,
      cast(c_nationkey as varchar) emp_status, cast(c_custkey as varchar) id_no,
      list_transform(range(14), lambda d: case when c_custkey % 4 = 0 and d = c_custkey % 14
        then {over}[(c_custkey // 14) % 11 + 1] else {pats}[c_custkey % 10 + 1][d + 1] end) codes
    from customer"""


def roster_events() -> str:
    return """
    select u.user_id // 500 * 100000 + u.period roster_id, cast(u.user_id % 500 as int) row_idx, concat('user', u.user_id) as name, 'events' station,
      '' emp_status, cast(u.user_id as varchar) id_no,
      list(case when e.n is null then 'RD' else concat(case when e.h < 6 then 'C' when e.h < 14 then 'A' else 'B' end,
           case when e.n >= 3 then 'OT' else '' end) end order by d.d) codes
    from (select distinct user_id, date_diff('day', date '2024-01-01', cast(ts as date)) // 14 period from events) u
    cross join (select unnest(range(14)) d) d
    left join (select user_id, date_diff('day', date '2024-01-01', cast(ts as date)) // 14 period, date_diff('day', date '2024-01-01', cast(ts as date)) % 14 d,
                 count(*) n, min(cast(extract(hour from ts) as int)) h from events group by 1, 2, 3) e
      on e.user_id = u.user_id and e.period = u.period and e.d = d.d group by 1, 2, 3, 6"""


def count(cond: str, lo: int = 1, hi: int = 14, what: str = "u") -> str:
    return f"len(list_filter({what}[{lo}:{hi}], lambda x: {cond}))"


def features(source: str = "", p: dict | None = None) -> str:
    """CTEs ro (roster), f1..f4 (features)."""
    return f"""
    with ro as ({source or roster()}),
    f1 as (select *, list_transform(codes, lambda c: upper(trim(c))) u, list_transform(codes, lambda c: trim(c)) s,
             list_transform(codes, lambda c: {HOURS.format(c='trim(c)')}) h from ro),
    f2 as (select *, {count('x in ' + LONG)} n43, {count('x in ' + SHORT)} n61, {count("x = 'RD'")} rd,
             {count('x in ' + REST)} rest, {count('x in ' + REST, 6, 7)} + {count('x in ' + REST, 13, 14)} wknd,
             {count("x = 'RD'", 1, 5)} + {count("x = 'RD'", 8, 12)} wkrd,
             list_sum(h[1:7]) ha, list_sum(h[8:14]) hb from f1),
    f3 as (select *, case when n43 > 0 and n61 = 0 then '4-3'
              when n61 > 0 and n43 = 0 then case when wknd = 4 and wkrd = 0 then '5-2' else '6-1' end
              when n43 > 0 then case when n43 > n61 or rd >= 4 then '4-3' else '6-1' end
              when rest >= 6 then '4-3' when wknd = 4 and wkrd = 0 then '5-2' else '6-1' end matrix from f2),
    f4 as (select *,
        case when matrix = '4-3' then greatest({count('x > 0', 1, 7, 'h')} - 4, 0) * 12 else {count('x in ' + LONG, 1, 7)} * 4 end ot_a,
        case when matrix = '4-3' then greatest({count('x > 0', 8, 14, 'h')} - 4, 0) * 12 else {count('x in ' + LONG, 8, 14)} * 4 end ot_b,
        {credit(1)} cr_a, {credit(8)} cr_b,
        {count('x in ' + REST, 1, 7)} rest_a, {count('x in ' + REST, 8, 14)} rest_b,
        list_transform(range(8), lambda i: list_sum(h[i + 1:i + 7])) wins,
        list_transform(range(1, 14), lambda i: 24 + ({START.format(c='s[i + 1]')}) - ({END.format(c='s[i]')})) gaps
      from f3)"""


def credit(lo: int) -> str:
    return (f"case when matrix = '5-2' then 9 * {count('x in ' + CRED, lo, lo + 3)} + 8 * {count('x in ' + CRED, lo + 4, lo + 4)} "
            f"else {count('x in ' + CRED, lo, lo + 6)} * case when matrix = '4-3' then 12 else 8 end end")


def ndays(test: str, text: str, sep: str = ", ", n: int = 14) -> str:
    """Joined item texts of the days i (1-based) that pass ``test``."""
    return f"array_to_string(list_transform(list_filter(range(1, {n + 1}), lambda i: {test}), lambda i: {text}), '{sep}')"


def messages(max_week="60", min_week="48", roll="60", nw="0") -> str:
    """CTE f5: m_<key> (text without the fail mark, empty when passed), then f6: ok_<key>, msg_<key>, pass."""
    d = f"{DAY_LIST}[i]"
    floor = f"case when matrix = '5-2' and {min_week} = 48 then 44 else {min_week} end"
    nwa, nwb = [f"greatest({nw}, 0) * " + count("x = 'NW'", *r) for r in ((1, 7), (8, 14))]
    ea, eb = f"(ha + cr_a + {nwa})", f"(hb + cr_b + {nwb})"
    bad_day = ("h[i] > 0 and case when matrix = '5-2' then case when (i - 1) % 7 <= 3 then h[i] <> 9 when (i - 1) % 7 = 4 then h[i] <> 8 else true end "
               "when matrix = '4-3' then h[i] <> 12 else h[i] < 8 or h[i] > 12 end")
    day_text = (f"concat({d}, '(', h[i], 'h', case when matrix <> '5-2' then '' when (i - 1) % 7 <= 3 then ', expected 9h' "
                "when (i - 1) % 7 = 4 then ', expected 8h' else ', expected RD' end, ')')")
    need = "(case matrix when '4-3' then case when ot_{x} > 0 then 2 else 3 end when '5-2' then 2 else 1 end)"
    na, nb = need.format(x="a"), need.format(x="b")
    run = "list_max(list_transform(range(1, 15), lambda i: list_max(list_transform(range(i, 15), lambda j: case when list_min(h[i:j]) > 0 then j - i + 1 else 0 end))))"
    blocks = "len(list_filter(range(1, len({w}) + 1), lambda i: {w}[i] = 'RD' and (i = 1 or {w}[i - 1] <> 'RD')))"
    wk = "list_filter(u[{r}], lambda x: x not in " + EXTRA + ")"
    ba, bb = blocks.format(w=wk.format(r="1:7")), blocks.format(w=wk.format(r="8:14"))
    limit = "(case when matrix = '6-1' then 6 else 5 end)"
    return f""",
    f5 as (select *, {run} longest, list_max(wins) worst, {ba} blk_a, {bb} blk_b,
        {ndays(bad_day, day_text)} m_max_day,
        concat_ws(', ', case when ha > {max_week} then concat('Wk A: ', ha, 'h') end, case when hb > {max_week} then concat('Wk B: ', hb, 'h') end) mw,
        concat_ws(', ', case when {ea} < {floor} then concat('Wk A: ', {ea}, 'h') end, case when {eb} < {floor} then concat('Wk B: ', {eb}, 'h') end) nw,
        {ndays("u[i] not in " + VALID, f"concat({d}, '(', codes[i], ')')")} mv,
        concat_ws(', ', case when rest_a < {na} then concat('Wk A: ', rest_a, ' RDs (need ', {na}, ')') end,
                        case when rest_b < {nb} then concat('Wk B: ', rest_b, ' RDs (need ', {nb}, ')') end) m_min_rd,
        {ndays("gaps[i] < 8", f"concat({d}, '→', {DAY_LIST}[i + 1], ' (', s[i], '→', s[i + 1], ', ', gaps[i], 'h gap, min 8h)')", '; ', 13)} m_shift_gap,
        concat_ws('; ', case when {count("x = 'RH'")} > 0 then concat('RH 200%: ', {ndays("u[i] = 'RH'", d)}) end,
                        case when {count("x = 'SPH'")} > 0 then concat('SPH 130%: ', {ndays("u[i] = 'SPH'", d)}) end) hol
      from f4),
    f5b as (select *, list_position(wins, worst) ws, list_filter(range(1, 15), lambda i: i + longest - 1 <= 14 and list_min(h[i:i + longest - 1]) > 0)[1] rs from f5),
    f5c as (select *,
        case when mw <> '' then concat(mw, ' exceeds max ', {max_week}, 'h') else '' end m_max_week,
        case when worst > {roll} then concat(worst, 'h in ', {DAY_LIST}[ws], '→', {DAY_LIST}[ws + 6], ' (max ', {roll}, 'h rolling 7d)') else '' end m_max_rolling_7d,
        case when nw <> '' then concat(nw, ' below min ', {floor}, 'h') else '' end m_min_week,
        case when longest > {limit} then concat(longest, ' consecutive work days in ', case when rs <= 7 and rs + longest - 1 >= 8 then 'Wk A & Wk B (cross-week)'
             when rs <= 7 then 'Wk A' else 'Wk B' end, ' (Max ', {limit}, ')') else '' end m_max_consecutive,
        case when mv <> '' then concat('Invalid: ', mv) else '' end m_valid_codes,
        case when matrix in ('4-3', '5-2') and (blk_a > 1 or blk_b > 1) then concat('Broken Rest Days in ',
             concat_ws(' & ', case when blk_a > 1 then 'Wk A' end, case when blk_b > 1 then 'Wk B' end), ' (Must be consecutive)') else '' end m_broken_rd,
        '' m_holiday_pay
      from f5b),
    f6 as (select *, {', '.join(f"m_{k} = '' ok_{k}" for k, _ in RULES)},
        {', '.join(f"case when m_{k} = '' then '✅' else concat('❌ ', m_{k}) end msg_{k}" for k, _ in RULES if k != 'holiday_pay')},
        case when hol = '' then '✅' else concat('ℹ️ ', hol) end msg_holiday_pay,
        {' and '.join(f"m_{k} = ''" for k, _ in RULES)} pass from f5c)"""


def results(source: str = "", **policy: str) -> str:
    return features(source) + messages(**policy)


TENTHS = "case when {d} = 0 then '0.0%' else concat(cast(round_even({n} * 1000.0 / {d}, 0) as bigint) // 10, '.', cast(round_even({n} * 1000.0 / {d}, 0) as bigint) % 10, '%') end"
MEAN = "case when {d} = 0 then 0.0 else cast(round_even({n} * 10.0 / {d}, 0) as double) / 10.0 end"


def tenths(n: str, d: str) -> str:
    return TENTHS.format(n=n, d=d)


def violations() -> str:
    """CTE vio over f6."""
    other = ",".join(
        f"case when not ok_{k} then {{'type': '{n}', 'details': m_{k}}} end"
        for k, n in RULES if k not in ("max_day", "shift_gap"))
    return results() + f""",
    v0 as (select *, list_concat(
        case when m_max_day <> '' then [{{'type': 'Daily Hours Check', 'details': m_max_day}}] else [] end,
        case when m_shift_gap <> '' then list_transform(string_split(m_shift_gap, '; '), lambda x: {{'type': 'Mandatory Shift Gap', 'details': x}}) else [] end,
        list_filter([{other}], lambda x: x is not null)) vs from f6 where not pass),
    vio as (select roster_id, row_idx, cast(g.i as int) - 1 ord, id_no, name, station, case when rd >= 6 then '4-3' else '6-1' end matrix,
              vs[g.i].type as type, vs[g.i].details as details
            from v0, (select unnest(range(1, 30)) i) g where g.i <= len(vs))"""


def cards() -> str:
    structural = "('Maximum Weekly Hours','Minimum Weekly Hours','Minimum Rest Days','Consecutive Rest Days','Consecutive Work Days')"
    return violations() + f""",
    vt as (select roster_id, id_no, name, type, min(row_idx * 100 + ord) p from vio group by all),
    vt2 as (select roster_id, id_no, name, count(*) n_violations, string_agg(type, ', ' order by p) rules,
              count(*) filter (type in {structural}) structural from vt group by all),
    vd as (select roster_id, id_no, name, type, details, min(row_idx * 100 + ord) p, arg_min(station, row_idx * 100 + ord) station,
             arg_min(matrix, row_idx * 100 + ord) matrix, min(row_idx) row_idx from vio group by all),
    vd2 as (select roster_id, id_no, name, arg_min(station, p) station, arg_min(matrix, p) matrix, min(row_idx) row_idx,
              string_agg(concat('[', type, '] ', details), '  |  ' order by p) details from vd group by all),
    cards as (select *, case when contains(details, 'Wk A') and not contains(details, 'Wk B') then 'Week A'
                when contains(details, 'Wk B') and not contains(details, 'Wk A') then 'Week B' else 'Week A & Week B' end failed_weeks,
                case when structural > 0 then 'invalid' else 'warning' end severity,
                lower(concat_ws(' ', id_no, name, station, matrix, rules, details)) search_blob
              from vd2 join vt2 using (roster_id, id_no, name))"""


LEVEL = "case event_type when 'error' then 'ERROR' when 'signup' then 'WARNING' when 'click' then 'DEBUG' else 'INFO' end"


def log_lines() -> str:
    """CTE lines."""
    t = "substr(cast(ts as varchar), 1, {n})"
    return f"""
    with lines as (select concat('app.log.', {t.format(n=10)}) file,
      row_number() over (partition by {t.format(n=10)} order by ts, event_id) line_no,
      case when event_id % 17 = 0 then concat('Traceback line ', event_id)
       when event_id % 4 = 0 then concat('{{"ts":"', replace({t.format(n=19)}, ' ', 'T'), '","level":"', lvl, '","logger":"app.main","trace_id":"sesh-', user_id, '","message":"event ', event_type, '"}}')
       when event_id % 4 = 1 then concat({t.format(n=19)}, ' | AUDIT | trace_id=sesh-', user_id, ' | action="', event_type, '" user_id="user', user_id, '@example.com" ip="10.0.0.', user_id % 250, '" user_agent="ua"')
       else concat({t.format(n=19)}, ' | ', rpad(lvl, 8, ' '), ' | app.main | trace_id=sesh-', user_id, ' | event ', event_type, ' token=abc', event_id) end as value
      from (select *, {LEVEL} lvl from events) e)"""


def redacted(c: str, pii: bool = False) -> str:
    out = f"regexp_replace({c}, 'Bearer\\s+[A-Za-z0-9._\\-]+', 'Bearer ***', 'gi')"
    out = f"regexp_replace({out}, '\\beyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+', '***jwt***', 'g')"
    out = (f"regexp_replace({out}, '\\b(client_secret|refresh_token|access_token|id_token|code_verifier|client_assertion)"
           "\\s*=\\s*\"?[^\\s\"''&]+\"?', '\\1=\"***\"', 'gi')")
    out = f"regexp_replace({out}, '([?&])code=([^\\s&\"'']+)', '\\1code=***', 'gi')"
    out = f"regexp_replace({out}, '\\b(password|passwd|secret|token|api[_\\-]?key)\\s*=\\s*\"?[^\\s\"'']+\"?', '\\1=\"***\"', 'gi')"
    if pii:
        out = f"regexp_replace({out}, '\\b[\\w.+\\-]+@[\\w\\-]+\\.[\\w.\\-]+\\b', '***@***', 'g')"
    return out


TEXT = r"'^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s*\|\s*([A-Z]+)\s*\|\s*([^|]+?)\s*\|\s*trace_id=(\S+)\s*\|\s*(.*)$'"
AUDIT = r"'^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s*\|\s*AUDIT\s*\|\s*trace_id=(\S+)\s*\|\s*(.*)$'"


def records(lines: str = "") -> str:
    """CTE rec: redacted and parsed."""
    def field(j: str, text_group: int, audit: str, raw: str) -> str:
        return (f"case when ltrim(raw)[1:1] = '{{' and json_valid(raw) then coalesce(json_extract_string(raw, '$.{j}'), '') "
                f"when regexp_matches(raw, {TEXT}) then regexp_extract(raw, {TEXT}, {text_group}) "
                f"when regexp_matches(raw, {AUDIT}) then {audit} else {raw} end {j}")
    return (lines or log_lines()) + f""",
    red as (select file, line_no, {redacted('value')} raw from lines),
    rec as (select file, line_no, {field('ts', 1, f"regexp_extract(raw, {AUDIT}, 1)", "''")}, {field('level', 2, "'INFO'", "''")},
       {field('logger', 3, "'audit'", "''")}, {field('trace_id', 4, f"regexp_extract(raw, {AUDIT}, 2)", "''")},
       {field('message', 5, f"regexp_extract(raw, {AUDIT}, 3)", "raw")}, raw from red),
    rect as (select *, try_strptime(replace(ts, 'T', ' '), '%Y-%m-%d %H:%M:%S') tsv,
       case when level in ('CRITICAL','ERROR','WARNING','INFO','DEBUG') then level else 'DEBUG' end lv from rec)"""


def change_lines() -> str:
    return """
    with lines as (select concat('audit.log.', substr(cast(ts as varchar), 1, 10)) file,
      row_number() over (partition by substr(cast(ts as varchar), 1, 10) order by ts, event_id) line_no,
      concat(substr(cast(ts as varchar), 1, 19), ' | AUDIT | trace_id=sesh-', user_id, ' | ',
       case when event_type <> 'signup' then concat('action="', event_type, '" user_id="user', user_id, '"')
        when event_id % 7 = 5 then concat('action="admin_defaults_reset_to_factory" user_id="user', user_id, '"')
        when event_id % 7 = 6 then concat('action="admin_defaults_save_failed" user_id="user', user_id, '" error="disk full"')
        else concat('action="admin_defaults_saved" user_id="user', user_id, '" thresholds={"max_week_hrs": ', 50 + event_id % 20,
          ', "min_week_hrs": 48, "max_rolling_7d_hrs": 60, "nw_credit_hrs": 0} active_rule_keys=',
          case event_id % 5 when 0 then 'None' when 1 then '["max_day", "min_rd"]' when 2 then '["max_day", "max_week", "min_rd"]'
            when 3 then '["shift_gap"]' else '[]' end) end) as value
      from events)"""


def feed() -> str:
    """CTE feed."""
    names = "list_transform({l}, lambda k: case k " + " ".join(f"when '{k}' then '{n}'" for k, n in RULES) + " else k end)"

    def joined(x: str) -> str:
        return f"array_to_string({names.format(l=x)}, ', ')"
    return records(change_lines()) + f""",
    c0 as (select *, regexp_extract(message, 'action="([^"]*)"', 1) action, regexp_extract(message, 'user_id="([^"]*)"', 1) user_id,
        regexp_extract(message, 'error="([^"]*)"', 1) error, regexp_extract(message, 'thresholds=(.+?)(?:\\s+active_rule_keys=|$)', 1) th,
        regexp_extract(message, 'active_rule_keys=(.+?)\\s*$', 1) ak from rec),
    ch as (select * from c0 where starts_with(action, 'admin_defaults_')),
    c1 as (select *, action = 'admin_defaults_saved' sv, action = 'admin_defaults_reset_to_factory' rs,
        case when action = 'admin_defaults_saved' and ak <> 'None' then cast(cast(ak as json) as varchar[]) end ks from ch),
    c2 as (select *, count(*) filter (sv or rs) over (partition by file order by line_no rows between unbounded preceding and 1 preceding) nprev,
        max(case when sv or rs then line_no end) over (partition by file order by line_no rows between unbounded preceding and 1 preceding) pl from c1),
    c3 as (select a.*, b.ks pk from c2 a left join c1 b on a.file = b.file and a.pl = b.line_no),
    c4 as (select *, list_filter(ks, lambda k: not list_contains(pk, k)) added, list_filter(pk, lambda k: not list_contains(ks, k)) gone from c3),
    feed as (select file, line_no, ts, user_id, action,
        case when rs then 'Reset to factory defaults' when not sv then '⚠️ Save FAILED' else concat_ws(' · ', 'Thresholds updated',
          case when ks is null then 'Active rules set to code defaults' when pl is null then concat('Pinned set: ', len(ks), ' active rule(s)')
               when pk is null then concat('Pinned ', len(ks), ' active rule(s)') end,
          case when ks is not null and pk is not null and len(added) > 0 then concat('Pinned ', len(added), ' rule(s)') end,
          case when ks is not null and pk is not null and len(gone) > 0 then concat('Unpinned ', len(gone), ' rule(s)') end,
          case when ks is not null and pk is not null and len(added) = 0 and len(gone) = 0 then 'Saved (no active-rule change)' end) end summary,
        case when rs then 'All thresholds restored; active rules set to code defaults.' when not sv then error else concat_ws(' — ',
          replace(replace(replace(replace(th, '{{', ''), '}}', ''), '"', ''), ': ', '='),
          case when ks is not null and len(ks) > 0 and (pl is null or pk is null) then {joined('ks')} end,
          case when ks is not null and pk is not null and len(added) > 0 then concat('added: ', {joined('added')}) end,
          case when ks is not null and pk is not null and len(gone) > 0 then concat('removed: ', {joined('gone')}) end) end detail,
        message raw from c4)"""
