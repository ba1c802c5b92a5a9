"""Column functions over one employee's 14 shift codes. All narrow, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftledger import dims


def sql_literal(v) -> str:
    return str(v) if isinstance(v, int) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_map(mapping: dict) -> str:
    return "map(" + ", ".join(sql_literal(x) for kv in mapping.items() for x in kv) + ")"


def lookup(mapping: dict, key: Column) -> Column:
    """Literal map lookup that yields null for a missing key (ANSI-safe)."""
    return F.try_element_at(F.expr(sql_map(mapping)), key)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(dims.WHITESPACE))


WHITESPACE_SQL = "' \\t\\n\\r\\u000b\\u000c'"


def day_words_sql(codes: str = "codes") -> str:
    """14 codes -> 14 counter words (``dims.FIELDS``); cells with the exact spelling take one lookup.

    The builders ending in ``_sql`` return expression text: a rule set has thousands of nodes, and one
    parsed text is built far faster than as many single calls into the JVM.
    """
    exact, folded = sql_map(dims.EXACT_WORDS), sql_map(dims.FOLDED_WORDS)
    c = f"coalesce(get({codes}, i), '')"
    bare = f"trim(BOTH {WHITESPACE_SQL} FROM {c})"
    return (f"transform(sequence(0, 13), i -> coalesce(try_element_at({exact}, {c}), try_element_at({exact}, {bare}), "
            f"try_element_at({folded}, upper({bare})), {dims.UNKNOWN_WORD}L))")


def field_sql(word: str, name: str) -> str:
    """One counter out of a word or a sum of words."""
    shift, mask = dims.FIELDS[name]
    return f"cast(shiftright({word}, {shift}) & {mask}L as int)"


def rd_counts(codes: Column) -> Column:
    """struct(a, b): literal rest days per week."""
    def n(first: int) -> Column:
        return F.size(F.filter(F.slice(codes, first, 7), lambda c: F.upper(strip(c)) == "RD"))
    return F.struct(n(1).alias("a"), n(8).alias("b"))


def detect_matrix_sql(total: str = "word_a + word_b", sig: str = "sig") -> str:
    """Work pattern ``4-3`` / ``5-2`` / ``6-1`` from the 14-day word sum and the signature."""
    n43, n61, rd, extra = (field_sql(f"({total})", f) for f in ("long", "short", "rd", "extra"))
    rest = dims.symbols_of(dims.REST_EQUIVALENT)
    return f"""case
        when {n43} > 0 and {n61} > 0 then case when {n43} > {n61} or {rd} >= 4 then '4-3' else '6-1' end
        when {n43} > 0 or ({n61} = 0 and {rd} + {extra} >= 6) then '4-3'
        when {sig} rlike '^.{{5}}[{rest}]{{2}}.{{5}}[{rest}]{{2}}$' and not {sig} rlike '^(.{{0,4}}|.{{7,11}})R' then '5-2'
        else '6-1' end"""


def overtime_sql(week_word: str, matrix: str = "matrix") -> str:
    """Overtime hours of one week under the pattern's own rule."""
    extra_days = f"greatest({field_sql(week_word, 'worked')} - {dims.OT_FREE_DAYS_43}, 0)"
    return (f"case when {matrix} = '4-3' then {extra_days} * {dims.OT_HOURS_43} "
            f"else {field_sql(week_word, 'long')} * {dims.OT_HOURS_PER_LONG_SHIFT} end")


def day_key_sql(i: str) -> str:
    return "get(array(" + ", ".join(f"'{d}'" for d in dims.DAYS) + f"), {i})"


def fill_codes(codes: Column) -> Column:
    """Exactly 14 codes; a missing day or a null becomes the empty code."""
    return F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.coalesce(F.get(codes, i), F.lit("")))


def day_hours(codes: Column) -> Column:
    """Hours per day; the lookup is case-sensitive, so ``a`` counts nothing."""
    hours = {c: h for c, (h, _, _) in dims.SHIFTS.items()}
    return F.transform(codes, lambda c: F.coalesce(lookup(hours, strip(c)), F.lit(0)))


def week_hours(hours: Column) -> Column:
    """struct(a, b, total) from 14 daily hours."""
    def total(start: int) -> Column:
        return F.aggregate(F.slice(hours, start, 7), F.lit(0), lambda acc, x: acc + x)
    return F.struct(total(1).alias("a"), total(8).alias("b"), (total(1) + total(8)).alias("total"))


def rest_gap(codes: Column) -> Column:
    """13 gaps in hours between consecutive shifts; null where either side has no times."""
    start = {c: s for c, (_, s, _) in dims.SHIFTS.items() if s is not None}
    end = {c: e for c, (_, _, e) in dims.SHIFTS.items() if e is not None}
    return F.zip_with(
        F.slice(codes, 1, 13), F.slice(codes, 2, 13),
        lambda this, nxt: F.lit(24) + lookup(start, strip(nxt)) - lookup(end, strip(this)),
    )


def day_key(i: Column) -> Column:
    """0-based day index -> ``Mon_A`` .. ``Sun_B``."""
    return F.get(F.expr("array(" + ", ".join(f"'{d}'" for d in dims.DAYS) + ")"), i)


def week_dates(d: Column) -> Column:
    """Monday..Sunday of the week holding ``d``."""
    monday = F.trunc(d, "week")
    return F.when(d.isNotNull(), F.sequence(monday, F.date_add(monday, 6), F.expr("interval 1 day")))


def _month_day(d: Column) -> Column:
    return F.concat(F.month(d).cast("string"), F.lit("/"), F.dayofmonth(d).cast("string"))


def week_range(d: Column) -> Column:
    """`` (m/d – m/d)`` for the snapped week, empty without a date."""
    monday = F.trunc(d, "week")
    return F.when(d.isNull(), "").otherwise(
        F.concat(F.lit(" ("), _month_day(monday), F.lit(" – "), _month_day(F.date_add(monday, 6)), F.lit(")"))
    )


def week_label(which: Column, label_a: Column, label_b: Column) -> Column:
    return F.when(which == "A", label_a).otherwise(label_b)


def day_label(key: Column, label: Column, start: Column) -> Column:
    """``Mon (5/4)`` when the week has a date, else ``Mon <week label>``; other keys unchanged."""
    day = F.substring_index(key, "_", 1)
    suffix = F.regexp_extract(key, r"^[^_]*_(.*)$", 1)
    offset = lookup({d: i for i, d in enumerate(dims.WEEKDAYS)}, day)
    dated = F.concat(day, F.lit(" ("), _month_day(F.date_add(F.trunc(start, "week"), offset)), F.lit(")"))
    return (
        F.when(~suffix.isin("A", "B"), key)
        .when(start.isNotNull() & offset.isNotNull(), dated)
        .otherwise(F.concat(day, F.lit(" "), label))
    )


def shift_window_label(code: Column) -> Column:
    """``06:00–14:00``; an em dash for codes without times."""
    labels = {c: f"{s:02d}:00–{e % 24:02d}:00" for c, (_, s, e) in dims.SHIFTS.items() if s is not None}
    return F.coalesce(lookup(labels, code), F.lit("—"))


def shift_order(code: Column) -> Column:
    """Display rank of an upper-cased code: work, rest, then everything else together."""
    order = {c: i for i, c in enumerate(dims.WORK_ORDER + dims.REST_ORDER)}
    return F.coalesce(lookup(order, code), F.lit(len(order)))
