"""The ten compliance rules and ``validate``.

A roster row carries its 14 codes, so everything here is narrow: no exchange appears in the plan.

The row is first folded into 14 counter words and a 14-symbol signature (``dims``): every count a rule
needs is a bit field of a word sum, every order-sensitive test a short regular expression, so the flags
stay inside whole-stage codegen. Those base features are emitted through a one-element generator
(``pinned``): Catalyst pushes filters through projections by re-inlining their expressions, which would
recompute the features once per reference; it does not push below a generator, so each is computed
once, and a filter on a flag still runs before any message is built. Messages use array lambdas and
are evaluated only for rows that fail the rule.

A rule is a function ``Policy -> Rule`` (SQL text over the feature columns) registered by key;
``register_rule`` adds more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger import dims
from shiftledger.functions import roster as R

POLICY_COLUMNS = list(dims.FACTORY_POLICY) + ["active_rule_keys"]


def pinned(df: DataFrame, names: list[str]) -> DataFrame:
    """Re-emit columns through a generator so later filters refer to them instead of recomputing them."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


@dataclass(frozen=True)
class Policy:
    """SQL text of each threshold: a literal, or the column a policy join brought in."""
    max_week: str
    min_week: str
    max_rolling: str
    nw_credit: str


@dataclass(frozen=True)
class Rule:
    """SQL text: does the row pass, its message, and (for the two list rules) the single findings."""
    passed: str
    message: str
    items: str | None = None


NO_ITEMS = "cast(array() as array<string>)"


def _verdict(passed: str, detail: str) -> str:
    return f"case when {passed} then '{dims.PASS_MARK}' else concat('{dims.FAIL_MARK}', {detail}) end"


def _weekly(bad_a: str, text_a: str, bad_b: str, text_b: str, sep: str = ", ") -> str:
    return f"concat_ws('{sep}', case when {bad_a} then {text_a} end, case when {bad_b} then {text_b} end)"


def _hours(label: str, hours: str) -> str:
    return f"concat('{label}: ', {hours}, 'h')"


def _any(symbols: str) -> str:
    return f"[{symbols}]"


def _map_of(part: int) -> str:
    return R.sql_map({c: v[part] for c, v in dims.SHIFTS.items() if v[part] is not None})


def _bare(code: str) -> str:
    return f"trim(BOTH {R.WHITESPACE_SQL} FROM {code})"


def rule_max_day(p: Policy) -> Rule:
    def other_than(h: int) -> str:
        return _any("".join(dims.symbols_with_hours(x) for x in dims.WORK_HOURS if x != h))
    out_of_61 = "".join(dims.symbols_with_hours(h) for h in dims.WORK_HOURS if h < 8 or h > 12)
    passed = f"""not case matrix
        when '5-2' then sig rlike '^(.{{0,3}}|.{{7,10}}){other_than(9)}' or sig rlike '^(.{{4}}|.{{11}}){other_than(8)}'
          or sig rlike '^(.{{5,6}}|.{{12,13}}){_any(dims.WORKED)}'
        when '4-3' then sig rlike '{other_than(12)}'
        else {f"sig rlike '{_any(out_of_61)}'" if out_of_61 else "false"} end"""
    expected = "case when i % 7 <= 3 then if(h <> 9, '9h', null) when i % 7 = 4 then if(h <> 8, '8h', null) else 'RD' end"
    head = f"{R.day_key_sql('i')}, '(', h, 'h'"
    item = f"""case when h = 0 then null
        when matrix = '5-2' then concat({head}, ', expected ', {expected}, ')')
        when h < if(matrix = '4-3', 12, 8) or h > 12 then concat({head}, ')') end"""
    hours = f"transform(codes, c -> coalesce(try_element_at({_map_of(0)}, {_bare('c')}), 0))"
    found = f"array_compact(transform({hours}, (h, i) -> {item}))"
    items = f"case when {passed} then {NO_ITEMS} else {found} end"
    return Rule(passed, _verdict(passed, f"array_join({found}, ', ')"), items)


def rule_max_week(p: Policy) -> Rule:
    bad_a, bad_b = f"hrs_a > {p.max_week}", f"hrs_b > {p.max_week}"
    weeks = _weekly(bad_a, _hours("Wk A", "hrs_a"), bad_b, _hours("Wk B", "hrs_b"))
    passed = f"not ({bad_a} or {bad_b})"
    return Rule(passed, _verdict(passed, f"{weeks}, ' exceeds max ', {p.max_week}, 'h'"))


def rule_max_rolling_7d(p: Policy) -> Rule:
    # roll = hours * 8 + (7 - start): one maximum gives the worst window and, on ties, the first.
    worst, start = "shiftright(roll, 3)", "(7 - (roll & 7))"
    passed = f"{worst} <= {p.max_rolling}"
    return Rule(passed, _verdict(passed, (
        f"{worst}, 'h in ', {R.day_key_sql(start)}, '→', {R.day_key_sql(start + ' + 6')}, ' (max ', {p.max_rolling}, 'h rolling 7d)'")))


def rule_min_week(p: Policy) -> Rule:
    floor = f"if(matrix = '5-2' and {p.min_week} = {dims.FLOOR_DEFAULT}, {dims.FLOOR_52}, {p.min_week})"
    a, b = (f"(hrs_{x} + credit_{x} + greatest({p.nw_credit}, 0) * nw_{x})" for x in "ab")
    bad_a, bad_b = f"{a} < {floor}", f"{b} < {floor}"
    passed = f"not ({bad_a} or {bad_b})"
    weeks = _weekly(bad_a, _hours("Wk A", a), bad_b, _hours("Wk B", b))
    return Rule(passed, _verdict(passed, f"{weeks}, ' below min ', {floor}, 'h'"))


def rule_max_consecutive(p: Policy) -> Rule:
    work = _any(dims.WORKED)
    passed = f"not if(matrix = '6-1', sig rlike '{work}{{7}}', sig rlike '{work}{{6}}')"
    bits = f"translate(sig, '{dims.WORKED}', '{'1' * len(dims.WORKED)}')"
    longest = f"array_max(transform(regexp_extract_all({bits}, '1+', 0), x -> length(x)))"
    first = f"instr({bits}, repeat('1', {longest}))"
    where = (f"case when {first} <= 7 and {first} + {longest} - 1 >= 8 then 'Wk A & Wk B (cross-week)' "
             f"when {first} <= 7 then 'Wk A' else 'Wk B' end")
    return Rule(passed, _verdict(
        passed, f"{longest}, ' consecutive work days in ', {where}, ' (Max ', if(matrix = '6-1', 6, 5), ')'"))


def rule_valid_codes(p: Policy) -> Rule:
    known = ", ".join(f"'{c.upper()}'" for c in dims.SHIFTS)
    passed = f"instr(sig, '{dims.UNKNOWN_SYMBOL}') = 0"
    item = f"if(upper({_bare('c')}) in ({known}), null, concat({R.day_key_sql('i')}, '(', c, ')'))"
    return Rule(passed, _verdict(
        passed, f"'Invalid: ', array_join(array_compact(transform(codes, (c, i) -> {item})), ', ')"))


def rule_min_rd(p: Policy) -> Rule:
    def need(x: str) -> str:
        return f"case matrix when '4-3' then if(ot_{x} > 0, 2, 3) when '5-2' then 2 else 1 end"

    def text(x: str) -> str:
        return f"concat('Wk {x.upper()}: ', rest_{x}, ' RDs (need ', {need(x)}, ')')"
    bad_a, bad_b = f"rest_a < {need('a')}", f"rest_b < {need('b')}"
    passed = f"not ({bad_a} or {bad_b})"
    return Rule(passed, _verdict(passed, _weekly(bad_a, text("a"), bad_b, text("b"))))


def rule_broken_rd(p: Policy) -> Rule:
    clear = dims.symbols_of(dims.REST_EXTRA)
    # A second block: RD, transparent days, a day that is neither, and RD again later in the week.
    broken = f"R[{clear}]*[^R{clear}][^R]*R"
    bad_a, bad_b = f"substring(sig, 1, 7) rlike '{broken}'", f"substring(sig, 8, 7) rlike '{broken}'"
    passed = f"not (matrix <> '6-1' and ({bad_a} or {bad_b}))"
    weeks = _weekly(bad_a, "'Wk A'", bad_b, "'Wk B'", " & ")
    return Rule(passed, _verdict(passed, f"'Broken Rest Days in ', {weeks}, ' (Must be consecutive)'"))


def rule_shift_gap(p: Policy) -> Rule:
    passed = f"not sig rlike '{dims.short_gap_pattern()}'"
    this, nxt = _bare("get(codes, i)"), _bare("get(codes, i + 1)")
    gap = f"(24 + try_element_at({_map_of(1)}, {nxt}) - try_element_at({_map_of(2)}, {this}))"
    item = (f"if({gap} < {dims.MIN_GAP_HOURS}, concat({R.day_key_sql('i')}, '→', {R.day_key_sql('i + 1')}, ' (', {this}, '→', {nxt}, "
            f"', ', {gap}, 'h gap, min {dims.MIN_GAP_HOURS}h)'), null)")
    found = f"array_compact(transform(sequence(0, 12), i -> {item}))"
    items = f"case when {passed} then {NO_ITEMS} else {found} end"
    return Rule(passed, _verdict(passed, f"array_join({found}, '; ')"), items)


def rule_holiday_pay(p: Policy) -> Rule:
    def part(label: str, symbol: str) -> str:
        days = f"transform(filter(sequence(0, 13), i -> substring(sig, i + 1, 1) = '{symbol}'), i -> {R.day_key_sql('i')})"
        return f"if(instr(sig, '{symbol}') > 0, concat('{label}: ', array_join({days}, ', ')), null)"
    found = f"concat_ws('; ', {part('RH 200%', 'H')}, {part('SPH 130%', 'S')})"
    return Rule("true", f"if(sig rlike '[HS]', concat('{dims.INFO_MARK}', {found}), '{dims.PASS_MARK}')")


RuleFunction = Callable[[Policy], Rule]
REGISTRY: dict[str, tuple[str, RuleFunction]] = {
    key: (name, globals()[f"rule_{key}"]) for key, name in dims.RULES
}


def register_rule(key: str, name: str, fn: RuleFunction) -> None:
    """Add a user rule; its SQL text may use the roster columns and every column of ``features``."""
    REGISTRY[key] = (name, fn)


@dataclass(frozen=True)
class ArrowRule:
    """A rule in Python: a vectorised UDF over ``columns`` that returns struct<passed boolean, message string>."""

    udf: Callable[..., Column]
    columns: tuple[str, ...]


ARROW_RULES: dict[str, ArrowRule] = {}


def register_arrow_rule(key: str, name: str, udf: Callable[..., Column], *columns: str) -> None:
    """Add a user rule that SQL cannot express, as an Arrow or pandas UDF over roster columns and columns of ``features``.

    It stands beside the native rules, which stay compiled: one Arrow exchange hands it only its columns, and only where it is active. A
    null answer passes. The message of a row that passes is not looked at.
    """
    ARROW_RULES[key] = ArrowRule(udf, columns)
    passed = f"coalesce(_arrow_{key}.passed, true)"
    REGISTRY[key] = (name, lambda p: Rule(passed, _verdict(passed, f"coalesce(_arrow_{key}.message, '')")))


def unregister_rule(key: str) -> None:
    """Take a user rule out again."""
    REGISTRY.pop(key, None)
    ARROW_RULES.pop(key, None)


def registered_names() -> list[str]:
    return [name for name, _ in REGISTRY.values()]


def active_rules(keys: list[str] | None) -> list[str]:
    """None = every rule; a list is cut to registered keys and put into registry order."""
    return [k for k in REGISTRY if keys is None or k in keys]


def active_rules_column(keys: Column) -> Column:
    everything = F.array(*[F.lit(k) for k in REGISTRY])
    return F.when(keys.isNull(), everything).otherwise(F.array_intersect(everything, keys))


def features(roster: DataFrame) -> DataFrame:
    """Roster plus signature, pattern, hours, overtime, rest and credit counts (one pass, narrow).

    The codes array is cut or filled to 14 days here, so rules may index it freely.
    """
    keep = [f"`{c}`" for c in roster.columns]
    days = [f"word_{i}" for i in range(14)]

    def total(first: int, last: int) -> str:
        return "(" + " + ".join(days[first:last]) + ")"

    def credit52(first: int) -> str:
        """Leave credit of a 5-2 week: 9h Monday to Thursday, 8h Friday, nothing at the weekend."""
        return (f"{R.field_sql(total(first, first + 4), 'credited')} * 9 + {R.field_sql(days[first + 4], 'credited')} * 8")
    windows = ", ".join(f"{R.field_sql(total(i, i + 7), 'hours')} * 8 + {7 - i}" for i in range(8))
    base = {
        "sig": "concat(" + ", ".join(f"chr({R.field_sql(d, 'symbol')})" for d in days) + ")",
        "word_a": total(0, 7), "word_b": total(7, 14), "roll": f"greatest({windows})",
        "credit52_a": credit52(0), "credit52_b": credit52(7),
    }
    df = roster.selectExpr(*keep, f"{R.day_words_sql()} as words")
    df = df.selectExpr(*keep, *[f"coalesce(get(words, {i}), 0L) as {d}" for i, d in enumerate(days)])
    df = df.selectExpr(*keep, *[f"{sql} as {n}" for n, sql in base.items()])
    df = df.selectExpr("*", f"{R.detect_matrix_sql()} as matrix")
    df = pinned(df, [*base, "matrix"])
    out = {}
    for x in "ab":
        w = f"word_{x}"
        out |= {
            f"hrs_{x}": R.field_sql(w, "hours"), f"ot_{x}": R.overtime_sql(w), f"rd_{x}": R.field_sql(w, "rd"),
            f"rest_{x}": f"{R.field_sql(w, 'rd')} + {R.field_sql(w, 'extra')}", f"nw_{x}": R.field_sql(w, "nw"),
            f"credit_{x}": (f"case matrix when '5-2' then credit52_{x} when '4-3' then {R.field_sql(w, 'credited')} * 12 "
                            f"else {R.field_sql(w, 'credited')} * 8 end"),
        }
    out["ot_total"] = f"{out['ot_a']} + {out['ot_b']}"
    return df.selectExpr("*", *[f"{sql} as {n}" for n, sql in out.items()])


def policy_join(roster: DataFrame, policy: DataFrame, on: str = "policy_id") -> DataFrame:
    """Attach each roster row's thresholds. Spark broadcasts the policies if their size allows it; otherwise adaptive
    execution splits a frequent policy."""
    cols = policy.select(on, *[F.col(c).alias(f"policy_{c}") for c in POLICY_COLUMNS])
    return roster.join(cols, on, "left")


def _policy(df: DataFrame, policy: dict | None) -> Policy:
    values = dims.FACTORY_POLICY | (policy or {})

    def threshold(name: str) -> str:
        default = int(values[name])
        return f"coalesce(policy_{name}, {default})" if f"policy_{name}" in df.columns else str(default)
    return Policy(*[threshold(n) for n in dims.FACTORY_POLICY])


def validate(roster: DataFrame, policy: dict | None = None, active: list[str] | None = None) -> DataFrame:
    """Roster -> roster + overtime + one message per active rule + ``_pass``/``_gv``/``_dv``/``Status``.

    Thresholds come from ``policy`` or, after ``policy_join``, from the row's own policy; so do the
    active rules. A rule that is inactive for a row passes and has a null message there. ``ok_<key>``
    flags, ``sig`` and ``matrix`` stay available to the reports; a sink selects what it writes.
    """
    keys = active_rules(active)
    df = features(roster)
    df = df.withColumns({f"_arrow_{k}": ARROW_RULES[k].udf(*ARROW_RULES[k].columns) for k in keys if k in ARROW_RULES})
    per_row = "policy_active_rule_keys" in df.columns
    rules = {k: REGISTRY[k][1](_policy(df, policy)) for k in keys}

    def when_on(key: str, sql: str, otherwise: str) -> str:
        chosen = "policy_active_rule_keys"
        on = f"({chosen} is null or array_contains({chosen}, '{key}'))"
        return f"if({on}, {sql}, {otherwise})" if per_row else f"({sql})"
    flags = {k: when_on(k, rules[k].passed, "true") for k in keys}
    passed = " and ".join(flags.values()) if keys else "true"

    def found(key: str) -> str:
        return when_on(key, rules[key].items, NO_ITEMS) if key in rules else NO_ITEMS
    return df.selectExpr(
        *[f"`{c}`" for c in roster.columns], "sig", "matrix", "ot_a", "ot_b", "ot_total",
        *[f"{sql} as ok_{k}" for k, sql in flags.items()],
        *[f"{when_on(k, rules[k].message, 'cast(null as string)')} as msg_{k}" for k in keys],
        f"{passed} as _pass", f"{found('shift_gap')} as _gv", f"{found('max_day')} as _dv",
        f"if({passed}, 'Valid', 'Invalid') as Status")
