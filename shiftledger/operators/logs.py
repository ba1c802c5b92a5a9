"""Log analytics: parse, filter, count, tail, and the settings change feed.

``lines`` is (file, line_no, value); everything up to the aggregates is narrow and built-in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shiftledger import dims
from shiftledger.functions import text as X
from shiftledger.operators.ordering import carry, ordinal_bucket
from shiftledger.operators.rules import pinned

# --- fixed values: the text line formats and the JSON fields -----------------------------------
# One pattern for both: `ts | LEVEL | logger | trace_id=.. | message` and, without a logger,
# `ts | AUDIT | trace_id=.. | message`.
TEXT_LINE = (r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s*\|\s*([A-Z]+)\s*\|\s*(?:([^|]+?)\s*\|\s*)?"
             r"trace_id=(\S+)\s*\|\s*(.*)$")
JSON_FIELDS = "ts STRING, level STRING, logger STRING, trace_id STRING, message STRING"
PARSED = ["ts", "level", "logger", "trace_id", "message"]
SEPARATOR = "\x01"
BIN_SECONDS = [
    1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400,
    2 * 86400, 7 * 86400, 14 * 86400, 30 * 86400, 90 * 86400, 365 * 86400, 3650 * 86400, 36500 * 86400,
]


def parse_log(lines: DataFrame, audit_logger: str = "audit") -> DataFrame:
    """Add ts, level, logger, trace_id, message, raw; a line of no known format is its own message.

    Each line is matched once: JSON is decoded into one struct, a text line is rewritten into its five
    fields by a single replacement and split. The fields are pinned, so a later filter on one of them
    does not parse again. ``audit_logger`` is the logger given to text audit lines, which carry none.
    """
    v = F.col("value")
    stripped = F.btrim(v, F.lit(dims.WHITESPACE))
    as_json = stripped.startswith("{") & stripped.endswith("}") & F.try_parse_json(stripped).isNotNull()
    decoded = F.from_json(stripped, JSON_FIELDS, {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    groups = [F.regexp_extract(v, TEXT_LINE, i) for i in range(1, 6)]
    # The separator cannot come from the line itself, except where it holds that control character.
    replaced = F.split(F.regexp_replace(v, TEXT_LINE, SEPARATOR.join(f"${i}" for i in range(1, 6))), SEPARATOR)
    in_text = F.when(~v.contains(SEPARATOR), replaced).when(v.rlike(TEXT_LINE), F.array(*groups))
    whole = F.when(as_json, F.struct(decoded.alias("fields"), F.json_object_keys(stripped).alias("keys")))
    df = lines.withColumns({"_json": whole, "_text": in_text})
    json, text = F.col("_json"), F.col("_text")
    # A broken object is read as text, like any other line; a field that is there and null reads None.
    is_json = json.isNotNull()
    no_logger = F.get(text, F.lit(2)) == ""
    is_text = (F.size(text) == 5) & (~no_logger | (F.get(text, F.lit(1)) == "AUDIT"))
    audit = {"level": F.lit("INFO"), "logger": F.lit(audit_logger)}
    fields = {}
    for i, f in enumerate(PARSED):
        group = F.get(text, F.lit(i))
        if f in audit:
            group = F.when(no_logger, audit[f]).otherwise(group)
        fields[f] = F.when(is_json, F.coalesce(
            json["fields"][f], F.when(F.array_contains(json["keys"], f), "None"), F.lit(""))).when(is_text, group).otherwise(
            v if f == "message" else F.lit(""))
    kept = [c for c in lines.columns if c != "value"]
    out = df.select(*kept, *[c.alias(f) for f, c in fields.items()], v.alias("raw"))
    return pinned(out, [*PARSED, "raw"])


def log_records(lines: DataFrame, mask_pii: bool = False, json_first: bool = False,
                audit_logger: str = "audit") -> DataFrame:
    """Redact, then parse. With ``json_first`` each parsed field is redacted instead, so that masking a
    secret inside a JSON line cannot break the JSON (the raw line is still redacted as text)."""
    if not json_first:
        return parse_log(lines.withColumn("value", X.redact(F.col("value"), mask_pii)), audit_logger)
    records = parse_log(lines, audit_logger)
    return records.withColumns({c: X.redact(F.col(c), mask_pii) for c in ["message", "raw"]})


def log_filter(records: DataFrame, *, levels: list[str] | None = None, since: str | None = None,
               until: str | None = None, trace_id: str | None = None, grep: str | None = None,
               regex: bool = False) -> DataFrame:
    """AND of every given criterion; records without a level pass the level test."""
    out = records.filter(~F.col("raw").rlike(r"^\s*$"))
    if grep:
        out = out.filter(F.col("raw").rlike(f"(?iu){grep}") if regex
                         else F.lower("raw").contains(grep.lower()))
    if trace_id:
        out = out.filter(F.col("trace_id").contains(trace_id))
    if levels:
        out = out.filter((F.col("level") == "") | F.col("level").isin([lv.upper() for lv in levels]))
    ts = X.parse_ts(F.col("ts"))
    if since is not None:
        out = out.filter(ts >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        out = out.filter(ts <= F.lit(until).cast("timestamp_ntz"))
    return out


def log_kpis(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("errors"),
        F.count_if(F.col("level") == "WARNING").alias("warnings"))


def severity_histogram(records: DataFrame, maxbins: int = 60) -> DataFrame:
    """Events per time bin and level, with the narrowest width that needs at most ``maxbins`` bins.

    Records are counted per second and level once; the range (a scalar subquery) and the bins are both taken
    from those counts. The range looks at the counts too, so that both sides have the same shuffle and Spark
    runs it once.
    """
    seconds = F.unix_seconds(X.parse_ts(F.col("ts")).cast("timestamp"))
    counts = records.select(seconds.alias("sec"), X.coerce_level(F.col("level")).alias("level")).filter(
        "sec is not null").groupBy("sec", "level").agg(F.count(F.lit(1)).alias("n"))
    seen = F.when(F.col("n") > 0, F.col("sec"))
    span = counts.agg(F.min(seen).alias("lo"), F.max(seen).alias("hi"))
    fits = ", ".join(f"if(floor(hi / {w}) - floor(lo / {w}) + 1 <= {maxbins}, {w}L, null)" for w in BIN_SECONDS)
    widest = f"cast(ceil((hi - lo + 1) / {maxbins}) as bigint) * 2"  # beyond the listed widths
    width = span.select(F.expr(f"coalesce({fits}, {widest})")).scalar()
    start = (F.floor(F.col("sec") / F.col("width")) * F.col("width")).cast("bigint")
    return counts.withColumn("width", width).groupBy(start.alias("bin_start"), "width", "level").agg(
        F.sum("n").alias("events")).orderBy("bin_start", X.level_order(F.col("level")))


def tail(lines: DataFrame, max_lines: int = 2_000, max_bytes: int = 1024 * 1024) -> DataFrame:
    """Last lines of every file within both caps; ``line_no`` must count every line of the file.

    The last line number per file comes from a combined aggregate, so lines before the tail are dropped by a
    filter and a file of any length sends at most ``max_lines`` lines to the window that counts bytes. A line
    that starts exactly at the byte limit is dropped unless it is the first of its file, because a reader
    from the end cannot know it is whole.
    """
    max_lines, max_bytes = max(1, max_lines), max(1, max_bytes)
    ends = lines.groupBy("file").agg(F.max("line_no").alias("_last"))
    last = lines.join(ends, "file").filter(F.col("line_no") > F.col("_last") - max_lines).drop("_last")
    w = W.partitionBy("file").orderBy(F.col("line_no").desc()).rowsBetween(W.unboundedPreceding, 0)
    whole = (F.col("_bytes") < max_bytes) | ((F.col("line_no") == 1) & (F.col("_bytes") <= max_bytes))
    return last.withColumn("_bytes", F.sum(F.octet_length("value") + 1).over(w)).filter(whole).drop("_bytes")


def parse_audit(records: DataFrame) -> DataFrame:
    """action, user_id, error, thresholds and active_rule_keys text of an audit message."""
    m = F.col("message")
    user = X.audit_field(m, "user_id")
    return records.withColumns({
        "action": X.audit_field(m, "action"),
        "user_id": F.when(user == "", "unknown").otherwise(user),
        "error": X.audit_field(m, "error"),
        "thresholds": F.regexp_extract(m, r"thresholds=(.+?)(?:\s+active_rule_keys=|$)", 1),
        "active_rule_keys": F.regexp_extract(m, r"active_rule_keys=(.+?)\s*$", 1),
    })


#: A literal that is neither a list nor None.
OTHER_LITERAL = r"^\s*(\{.*\}|\(.*\)|-?\d+(\.\d+)?|True|False|'[^']*'|\"[^\"]*\")\s*$"


def summarize_save(thresholds: Column, keys: Column, prev: Column, other: Column | None = None) -> Column:
    """struct(summary, detail) of one save.

    ``thresholds`` is a map, ``keys`` the saved rule keys (null = code defaults), ``prev`` the previous snapshot
    as struct(keys): a null struct means none is in view, null keys mean code defaults. ``other`` says that a value was
    saved that is no list: nothing is said of rules then.
    """
    other = F.lit(False) if other is None else other
    has_thresholds = thresholds.isNotNull() & (F.size(thresholds) > 0)
    values = F.array_join(F.transform(F.map_entries(thresholds), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    count, names = F.size(keys).cast("string"), F.array_join(X.rule_names(keys), ", ")
    before = prev["keys"]
    compare = keys.isNotNull() & prev.isNotNull() & before.isNotNull()
    # Membership tests, not array_except: a key listed twice is reported twice.
    added = F.filter(keys, lambda k: ~F.array_contains(before, k))
    removed = F.filter(before, lambda k: ~F.array_contains(keys, k))
    some_added, some_removed = compare & (F.size(added) > 0), compare & (F.size(removed) > 0)
    absolute = keys.isNotNull() & (prev.isNull() | before.isNull())

    def n(c: Column) -> Column:
        return F.size(c).cast("string")
    summary = F.concat_ws(
        " · ",
        F.when(has_thresholds, "Thresholds updated"),
        F.when(keys.isNull() & ~other, "Active rules set to code defaults"),
        F.when(absolute & prev.isNull(), F.concat(F.lit("Pinned set: "), count, F.lit(" active rule(s)"))),
        F.when(absolute & prev.isNotNull(), F.concat(F.lit("Pinned "), count, F.lit(" active rule(s)"))),
        F.when(some_added, F.concat(F.lit("Pinned "), n(added), F.lit(" rule(s)"))),
        F.when(some_removed, F.concat(F.lit("Unpinned "), n(removed), F.lit(" rule(s)"))),
        F.when(compare & ~some_added & ~some_removed, "Saved (no active-rule change)"),
    )
    detail = F.concat_ws(
        " — ",
        F.when(has_thresholds, values),
        F.when(absolute & (F.size(keys) > 0), names),
        F.when(some_added, F.concat(F.lit("added: "), F.array_join(X.rule_names(added), ", "))),
        F.when(some_removed, F.concat(F.lit("removed: "), F.array_join(X.rule_names(removed), ", "))),
    )
    summary = F.when(summary == "", "Defaults saved").otherwise(summary)
    return F.struct(summary.alias("summary"), detail.alias("detail"))


def change_feed(records: DataFrame, action: str = "ALL", across_archives: bool = False) -> DataFrame:
    """Settings changes with a readable summary; each save is compared with the snapshot before it.

    The snapshot walk covers every change, the ``action`` filter comes after it. A file is walked on its
    own; ``across_archives`` walks a stream through its dated files instead. Display order is newest
    first: line_no (and file) descending.
    """
    changes = parse_audit(records.filter(F.lower("raw").contains("admin_defaults_"))).filter(
        F.col("action").isin(*dims.CHANGE_ACTIONS))
    saved, reset = F.col("action") == "admin_defaults_saved", F.col("action") == "admin_defaults_reset_to_factory"
    changes = changes.withColumns({
        "_keys": F.when(saved, X.python_literal(F.col("active_rule_keys"), "array<string>")),
        "_thresholds": F.when(saved, X.python_literal(F.col("thresholds"), "map<string,string>")),
    })
    snapshot = F.when(saved | reset, F.struct(F.col("_keys").alias("keys")))
    line = ordinal_bucket(F.col("line_no"))
    if across_archives:
        stream = F.regexp_extract("file", r"^([\w.]+?\.log)", 1)
        date = F.coalesce(F.nullif(F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})$", 1), F.lit("")), F.lit("9999"))
        changes = changes.withColumns({"_stream": stream, "_date": date})
        changes = carry(changes, ["_stream"], [F.col("_date"), line], ["_date", "line_no"], snapshot, "_prev")
    else:
        changes = carry(changes, ["file"], [line], ["line_no"], snapshot, "_prev")
    other = F.coalesce(F.col("active_rule_keys").rlike(OTHER_LITERAL), F.lit(False))
    save = summarize_save(F.col("_thresholds"), F.col("_keys"), F.col("_prev"), other)

    def text(for_save: Column, for_reset: str, failed_save: Column, failed_reset: Column) -> Column:
        return (F.when(saved, for_save).when(reset, for_reset)
                .when(F.col("action") == "admin_defaults_save_failed", failed_save).otherwise(failed_reset))
    feed = changes.select(
        "file", "line_no", "ts", "user_id", "action",
        text(save["summary"], "Reset to factory defaults", F.lit("⚠️ Save FAILED"), F.lit("⚠️ Reset FAILED")).alias("summary"),
        text(save["detail"], "All thresholds restored; active rules set to code defaults.",
             F.col("error"), F.col("error")).alias("detail"),
        F.col("message").alias("raw"))
    return feed if action == "ALL" else feed.filter(F.col("action") == action)


def feed_search(feed: DataFrame, q: str) -> DataFrame:
    """Substring in the synthesised text; the query is scrubbed like any other filter term."""
    needle = "".join(ch for ch in q or "" if ch >= " " and ch != "\x7f").lower()
    if not needle:
        return feed
    hit = F.lit(False)
    for c in ("summary", "detail", "user_id", "action"):
        hit = hit | F.lower(c).contains(needle)
    return feed.filter(hit)


def change_kpis(feed: DataFrame) -> DataFrame:
    return feed.agg(
        F.count(F.lit(1)).alias("changes"),
        F.count_if(F.col("action") == "admin_defaults_saved").alias("saves"),
        F.count_if(F.col("action") == "admin_defaults_reset_to_factory").alias("resets"),
        F.count_if(F.col("action").endswith("_failed")).alias("failures"),
        F.coalesce(F.max_by("ts", F.struct("file", "line_no")), F.lit("—")).alias("latest"))


def threshold_change_log(settings: DataFrame, part: list[str], order: str, setting: str = "setting",
                         value: str = "value", bucket: Column | None = None) -> DataFrame:
    """A row whenever a setting differs from the value seen before it in the same session."""
    bucket = ordinal_bucket(F.col(order)) if bucket is None else bucket
    seen = carry(settings, [*part, setting], [bucket], [order], F.col(value), "old_value")
    return seen.filter(F.col("old_value").isNotNull() & (F.col("old_value") != F.col(value)))
