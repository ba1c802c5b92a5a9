"""Fixed dimensions of the schedule domain: days, shifts, rules, factory policy.

Everything in this module is a plain value that results depend on; nothing here touches Spark.
"""

from __future__ import annotations

# --- fixed values: the 14-day axis -------------------------------------------------------------
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
DAYS_A = [f"{d}_A" for d in WEEKDAYS]
DAYS_B = [f"{d}_B" for d in WEEKDAYS]
DAYS = DAYS_A + DAYS_B

# --- fixed values: shift code -> (hours, start hour, end hour); end may pass midnight ------------
SHIFTS = {
    "A": (8, 6, 14),
    "B": (8, 14, 22),
    "C": (8, 22, 30),
    "AOT": (12, 6, 18),
    "BOT": (12, 10, 22),
    "COT": (12, 18, 30),
    "OS5": (9, 8, 17),
    "RD": (0, None, None),
    "Leave": (0, None, None),
    "AWOL": (0, None, None),
    "NW": (0, None, None),
    "RH": (0, None, None),
    "SPH": (0, None, None),
    "": (0, None, None),
}

# --- fixed values: spelling of codes in uploaded grids (upper-cased) -> code ----------------------
CODE_ALIASES = {
    "A": "A", "B": "B", "C": "C",
    "AOT": "AOT", "BOT": "BOT", "COT": "COT",
    "OS5": "OS5", "RD": "RD", "LEAVE": "Leave",
    "CS": "C", "BS": "B", "AS": "A",
    "AWOL": "AWOL", "NW": "NW", "RH": "RH", "SPH": "SPH",
}

# --- fixed values: code groups (upper-cased) and overtime constants -----------------------------
LONG_SHIFTS = ["AOT", "BOT", "COT"]
SHORT_SHIFTS = ["A", "B", "C", "OS5"]
REST_EQUIVALENT = ["RD", "LEAVE", "RH", "SPH", "NW"]
REST_EXTRA = ["LEAVE", "RH", "SPH", "NW"]
CREDITED = ["LEAVE", "RH", "SPH"]
OT_HOURS_PER_LONG_SHIFT = 4
OT_FREE_DAYS_43 = 4
OT_HOURS_43 = 12
WORK_ORDER = ["A", "B", "C", "AOT", "BOT", "COT", "OS5"]
REST_ORDER = ["RD", "LEAVE", "RH", "SPH", "NW", "AWOL"]
MIN_GAP_HOURS = 8

# --- fixed values: rule registry (order fixes column and violation order) -----------------------
RULES = [
    ("max_day", "Daily Hours Check"),
    ("max_week", "Maximum Weekly Hours"),
    ("max_rolling_7d", "Max Rolling 7-Day Hours"),
    ("min_week", "Minimum Weekly Hours"),
    ("max_consecutive", "Consecutive Work Days"),
    ("valid_codes", "Valid Shift Codes"),
    ("min_rd", "Minimum Rest Days"),
    ("broken_rd", "Consecutive Rest Days"),
    ("shift_gap", "Mandatory Shift Gap"),
    ("holiday_pay", "Holiday Pay Flag"),
]
RULE_KEYS = [k for k, _ in RULES]
RULE_NAMES = dict(RULES)
STRUCTURAL_RULES = [
    "Maximum Weekly Hours", "Minimum Weekly Hours", "Minimum Rest Days",
    "Consecutive Rest Days", "Consecutive Work Days",
]
PASS_MARK = "✅"
FAIL_MARK = "❌ "
INFO_MARK = "ℹ️ "

# --- fixed values: factory policy and its accepted ranges --------------------------------------
FACTORY_POLICY = {"max_week_hrs": 60, "min_week_hrs": 48, "max_rolling_7d_hrs": 60, "nw_credit_hrs": 0}
POLICY_RANGES = {
    "max_week_hrs": (40, 84), "min_week_hrs": (0, 60),
    "max_rolling_7d_hrs": (40, 84), "nw_credit_hrs": (0, 12),
}
FLOOR_DEFAULT, FLOOR_52 = 48, 44

# --- fixed values: grid parsing -----------------------------------------------------------------
META_KEYWORDS = {
    "name": ["operator", "name"],
    "station": ["station", "designation"],
    "status": ["status", "emp"],
    "id": ["id no", "id.", "emp no", "empno", "id"],
}
SKIPPED_NAMES = ["nan", "name", "operator's name", "operators name", "none", ""]
MAX_FILE_BYTES = 5 * 1024 * 1024
MAX_FILE_CELLS = 500_000
HEADER_MIN_DAYS = 10

# --- fixed values: logs ------------------------------------------------------------------------
LOG_BASES = ["app.log", "audit.log", "app.json.log"]
LIVE_LABEL = "Today (live)"
LEVELS = ["CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG"]
CHANGE_ACTIONS = [
    "admin_defaults_saved", "admin_defaults_reset_to_factory",
    "admin_defaults_save_failed", "admin_defaults_reset_failed",
]

# What Python's str.strip() removes from ASCII text; Spark's trim() alone removes only spaces.
WHITESPACE = " \t\n\r\x0b\x0c"

# --- one symbol and one counter word per shift code -----------------------------------------------
# A code becomes one BIGINT whose bit fields are counters (hours worked, "is a rest day", ...), so that
# adding words over any stretch of days yields every count of that stretch at once. The top field is
# the code's symbol; the 14 symbols side by side form a signature such as AAAAAARBBBBBBR, on which the
# order-sensitive rules are short regular expressions.
#
# A work code written with the exact spelling carries hours and times; in another case it is still
# *recognised* (pattern, overtime, validity) but carries no hours, and gets the lower-case symbol.
SYMBOLS = {
    "A": "A", "B": "B", "C": "C", "AOT": "X", "BOT": "Y", "COT": "Z", "OS5": "O",
    "RD": "R", "Leave": "L", "AWOL": "W", "NW": "N", "RH": "H", "SPH": "S", "": "_",
}
UNKNOWN_SYMBOL = "?"
# field -> (shift, mask); every field holds its largest 14-day sum without carrying into the next
FIELDS = {
    "hours": (0, 0xFF), "long": (8, 0xF), "short": (12, 0xF), "rd": (16, 0xF), "extra": (20, 0xF),
    "credited": (24, 0xF), "nw": (28, 0xF), "worked": (32, 0xF), "unknown": (36, 0xF), "symbol": (40, 0xFF),
}


def _word(symbol: str, **counts: int) -> int:
    return sum(v << FIELDS[f][0] for f, v in (counts | {"symbol": ord(symbol)}).items())


def code_word(code: str, exact: bool = True) -> int:
    hours, up = SHIFTS[code][0], code.upper()
    counted = hours if exact else 0
    return _word(
        SYMBOLS[code] if exact or not hours else SYMBOLS[code].lower(),
        hours=counted, worked=int(counted > 0),
        long=int(up in LONG_SHIFTS), short=int(up in SHORT_SHIFTS), rd=int(up == "RD"),
        extra=int(up in REST_EXTRA), credited=int(up in CREDITED), nw=int(up == "NW"),
    )


EXACT_WORDS = {c: code_word(c) for c in SHIFTS}
FOLDED_WORDS = {c.upper(): code_word(c, exact=False) for c in SHIFTS}
UNKNOWN_WORD = _word(UNKNOWN_SYMBOL, unknown=1)


def symbols_of(codes: list[str]) -> str:
    """Exact-spelling symbols of the given upper-cased codes."""
    return "".join(s for c, s in SYMBOLS.items() if c.upper() in codes)


def symbols_with_hours(hours: int) -> str:
    return "".join(SYMBOLS[c] for c, (h, _, _) in SHIFTS.items() if h == hours)


WORK_HOURS = sorted({h for h, _, _ in SHIFTS.values() if h > 0})
WORKED = "".join(symbols_with_hours(h) for h in WORK_HOURS)


def short_gap_pattern(min_gap: int = MIN_GAP_HOURS) -> str:
    """Regular expression over two adjacent symbols whose rest gap is below ``min_gap`` hours."""
    parts = []
    for code, (_, _, end) in SHIFTS.items():
        if end is None:
            continue
        nxt = "".join(
            SYMBOLS[c] for c, (_, start, _) in SHIFTS.items()
            if start is not None and 24 + start - end < min_gap
        )
        if nxt:
            parts.append(f"{SYMBOLS[code]}[{nxt}]")
    return "|".join(parts)
