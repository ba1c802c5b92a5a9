"""Column functions over log lines and free text: cleaning, redaction, dates, audit fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger import dims
from shiftledger.functions.roster import lookup

# --- fixed values: patterns whose matches decide results ---------------------------------------
CONTROL_CHARS = r"[\x00-\x1f\x7f]"
REDACTIONS = [
    (r"(?iU)Bearer\s+[A-Za-z0-9._\-]+", "Bearer ***"),
    (r"(?U)\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "***jwt***"),
    (r"(?iU)\b(client_secret|refresh_token|access_token|id_token|code_verifier|client_assertion)"
     r"\s*=\s*\"?[^\s\"'&]+\"?", '$1="***"'),
    (r"(?iU)([?&])code=([^\s&\"']+)", "$1code=***"),
    (r"(?iU)\b(password|passwd|secret|token|api[_\-]?key)\s*=\s*\"?[^\s\"']+\"?", '$1="***"'),
]
REDACTION_EMAIL = (r"(?U)\b[\w.+\-]+@[\w\-]+\.[\w.\-]+\b", "***@***")
# Every pattern above needs one of these words, so a line without any is passed through unmatched.
REDACTION_WORDS = ["bearer", "eyj", "code=", "secret", "token", "code_verifier", "client_assertion", "passw", "api"]


def scrub_ctrl(c: Column, quotes: bool = False, limit: int | None = None) -> Column:
    """Cut to ``limit`` characters, drop ASCII control characters, optionally turn ``"`` into ``'``."""
    out = F.substring(c, 1, limit) if limit is not None else c
    out = F.regexp_replace(out, CONTROL_CHARS, "")
    return F.translate(out, '"', "'") if quotes else out


def csv_safe_value(c: Column) -> Column:
    """Prefix ``'`` when a spreadsheet would read the cell as a formula."""
    return F.when(c.rlike(r"^[\t\r\n]*[=+\-@|]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_safe(df: DataFrame) -> DataFrame:
    return df.select(*[
        csv_safe_value(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def redact(c: Column, mask_pii: bool = False) -> Column:
    """Mask tokens and secrets, in a fixed order; e-mail addresses only on request."""
    out = c
    for pattern, replacement in REDACTIONS:
        out = F.regexp_replace(out, pattern, replacement)
    # Long s and the Kelvin sign equal s and k when case is ignored.
    low = F.lower(F.replace(F.replace(c, F.lit("\u017f"), F.lit("s")), F.lit("\u212a"), F.lit("k")))
    hinted = reduce(lambda a, b: a | b, [low.contains(w) for w in REDACTION_WORDS])
    out = F.when(hinted, out).otherwise(c)
    if mask_pii:
        pattern, replacement = REDACTION_EMAIL
        out = F.when(F.instr(out, "@") > 0, F.regexp_replace(out, pattern, replacement)).otherwise(out)
    return out


def parse_ts(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, with any white space between, or its ISO ``T`` form; anything else is null."""
    shape = c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}(T|\s+)\d{1,2}:\d{1,2}:\d{1,2}\z")
    plain = F.regexp_replace(c, r"T|\s+", " ")
    return F.when(shape, F.try_to_timestamp(plain, F.lit("yyyy-M-d H:m:s")).cast("timestamp_ntz"))


def coerce_level(c: Column) -> Column:
    up = F.upper(F.coalesce(c, F.lit("")))
    return F.when(up.isin(*dims.LEVELS), up).otherwise("DEBUG")


def level_order(level: Column) -> Column:
    return lookup({lv: i for i, lv in enumerate(dims.LEVELS)}, level)


def audit_field(message: Column, name: str) -> Column:
    """First ``name="value"`` in an audit message, or the empty string."""
    return F.regexp_extract(message, f'{name}="([^"]*)"', 1)


def audit_pairs(message: Column) -> Column:
    """Every ``key="value"`` of an audit message as a map; the first occurrence of a key wins."""
    keys = F.regexp_extract_all(message, F.lit(r'(\w+)="[^"]*"'), F.lit(1))
    values = F.regexp_extract_all(message, F.lit(r'\w+="([^"]*)"'), F.lit(1))
    pairs = F.arrays_zip(keys.alias("key"), values.alias("value"))
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.map_from_entries(first)


def python_literal(c: Column, schema: str) -> Column:
    """Value of a printed dict or list (single or double quotes); ``None`` or junk is null."""
    text = F.trim(c)
    return F.when((text != "") & (text != "None"), F.from_json(text, schema))


def rule_names(keys: Column) -> Column:
    """Rule keys -> display names, unknown keys kept."""
    return F.transform(keys, lambda k: F.coalesce(lookup(dims.RULE_NAMES, k), k))


def format_kv(action: Column, user_id: Column, ip: Column, user_agent: Column,
              details: dict[str, Column]) -> Column:
    """One audit line body: the four fixed fields, then scrubbed ``k="v"`` details."""
    def pair(k: str, v: Column) -> Column:
        return F.concat(F.lit(f'{k}="'), v, F.lit('"'))
    fixed = [pair("action", action), pair("user_id", user_id), pair("ip", ip), pair("user_agent", user_agent)]
    rest = [pair(k, scrub_ctrl(v.cast("string"), quotes=True)) for k, v in details.items()]
    return F.concat(F.concat_ws(" ", *fixed), F.lit(" "), F.concat_ws(" ", *rest))


def client_ip(peer: Column, xff: Column, xreal: Column, trusted: list[str]) -> Column:
    """Client address; forwarded headers count only when the peer is a trusted proxy."""
    def filled(c: Column) -> Column:
        return F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    direct = filled(peer)
    ip = direct
    if trusted:
        forwarded = filled(F.get(F.split(xff, ","), F.lit(0)))
        ip = F.when(direct.isin(*trusted), F.coalesce(forwarded, filled(xreal), direct)).otherwise(direct)
    return F.when(ip.isNull() | (ip == "unknown"), "127.0.0.1").otherwise(ip)


def user_name(remote_user: Column) -> Column:
    name = F.trim(F.coalesce(remote_user, F.lit("")))
    return F.when(name == "", "anonymous").otherwise(name)


def failed_weeks(details: Column, label_a: Column, label_b: Column) -> Column:
    """Which weeks a detail text blames; both when it names neither."""
    a, b = details.contains("Wk A"), details.contains("Wk B")
    return (
        F.when(a & ~b, label_a).when(b & ~a, label_b)
        .otherwise(F.concat(label_a, F.lit(" & "), label_b))
    )
