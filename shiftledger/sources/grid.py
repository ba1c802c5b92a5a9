"""Roster grids: uploaded CSV files -> lines of cells -> employees.

A file is read as text, in as many splits as its size asks for; no row and no task holds a whole file. A grid line is a
row (file, sheet_no, row_idx, cells). What is known of a whole file is a row of a small table beside the lines: its
width, its header, and its meta columns, each by one aggregation with partial sums.

A cell may hold line breaks in quotes, so a line of text need not begin a record. Whether it does follows from the quotes
before it: a line of text takes the state "outside" or "inside quotes" to a new one, the map of a split is the composition of
the maps of its lines, and the state at the start of each split follows from one row for each split.

Files of any size are read; the limits of an upload form are thresholds that a caller may set.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shiftledger import dims
from shiftledger.functions.roster import lookup, strip
from shiftledger.shared import shared_dir, written

# --- fixed values: words read as an empty cell, signatures, name filters -----------------------
EMPTY_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
DAY_CELL = "^(mon|tue|wed|thu|fri|sat|sun)"
DATE_NAME = (r"^\d{1,2}[/\-]\d{1,2}([/\-]\d{2,4})?$|^\d{4}[/\-]\d{1,2}[/\-]\d{1,2}$"
             r"|^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b[\s\-/]\d")
TOO_LARGE = "File too large. Maximum allowed size is 5MB."
BAD_XLSX = "File content does not match .xlsx signature. Try re-saving as Excel Workbook."
BAD_XLS = "File content does not match .xls signature. Try re-saving as Excel 97-2003."
UNREADABLE = "Could not read the file."
NO_DAYS = "No 14-day schedule columns found. Ensure 'Mon'–'Sun' appear twice in your header row."
NO_NAME = "No 'Name' column detected. Check your header row."

#: SQL text of what makes the name of a file from its metadata.
FILE_NAME = "_metadata.file_path"


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Inside, many folders are listed by as many tasks as a shuffle has; by default each folder is a task of its own."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    old = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(old), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    try:
        yield
    finally:
        spark.conf.set(setting, old)


def list_files(spark: SparkSession, path: str, name: str = FILE_NAME) -> DataFrame:
    """(file, length, content) of every file under ``path`` that is not empty; the content is read of workbooks alone, to see their signature.

    ``name`` is SQL text that makes the name of a file from its path.
    """
    with listing(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    file = F.expr(name)
    workbook = F.lower(file).rlike(r"\.xlsx?$")
    found = files.filter(workbook).select(file.alias("file"), "length", "content")
    return found.unionByName(files.filter(~workbook).select(file.alias("file"), "length", F.lit(None).cast("binary").alias("content")))


def read_text(spark: SparkSession, path: str, name: str = FILE_NAME, max_bytes: int | None = None) -> DataFrame:
    """(file, split, pos, value) of the lines of all CSV files under ``path``, in file order by split, then pos.

    Other files, and files over ``max_bytes``, are not opened.
    """
    with listing(spark):
        lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    if max_bytes is not None:
        lines = lines.filter(F.col("_metadata.file_size") <= max_bytes)
    return lines.filter(F.lower(F.expr(name)).endswith(".csv")).select(
        F.expr(name).alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("pos"), "value")


def guard_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Add ``reason``: null when the file may be read, else why it is rejected.

    Size comes first, if it is limited at all, so the content of an oversized file is not looked at.
    """
    ext = F.lower(F.regexp_extract("file", r"\.([^./]*)$", 1))
    magic = F.hex(F.substring("content", 1, 4))
    reason = (
        F.when(F.col("length") > F.lit(max_bytes).cast("bigint"), TOO_LARGE)
        .when((ext == "xlsx") & (magic != "504B0304"), BAD_XLSX)
        .when((ext == "xls") & (magic != "D0CF11E0"), BAD_XLS)
        .when(~ext.isin("csv", "xlsx", "xls"),
              F.concat(F.lit("Unsupported extension: ."), ext, F.lit(". Upload .xlsx, .xls, or .csv.")))
    )
    return files.withColumn("reason", reason)


def _too_many(n: Column, most: int) -> Column:
    return F.concat(F.lit("File rejected: workbook contains "), F.format_number(n, 0),
                    F.lit(f" cells, which exceeds the {most:,}-cell safety limit."))


#: Where the text of a line stands between two quotes: in an unquoted cell, inside quotes, after quotes that closed, at its start.
_PLAIN, _INSIDE, _CLOSED, _START = range(4)


def _after_quote(state: Column, before: Column) -> Column:
    """The state after a quote that follows the text ``before``: quotes open only at the start of a cell, and double inside quotes."""
    opens = ((state == _START) & (before == "")) | before.endswith(",") | ((state == _CLOSED) & (before == ""))
    return F.when(state == _INSIDE, _CLOSED).when(opens, _INSIDE).otherwise(_PLAIN)


def _ends_inside(value: Column, start: int) -> Column:
    """Whether quotes are open after a line that begins in state ``start``."""
    parts = F.split(value, '"', -1)
    before = F.slice(parts, 1, F.size(parts) - 1)
    end = F.aggregate(before, F.lit(start), _after_quote)
    return F.when(F.contains(value, F.lit('"')), end == _INSIDE).otherwise(F.lit(start == _INSIDE))


def _before(df: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """Add what a row of ``part`` needs to know its state: ``flips`` before it, and ``base``, the state that these flip.

    A row maps the state to another by (``from_out``, ``from_in``): it keeps it, flips it, or sets it. ``base`` is null
    where nothing before the row sets the state, so that the one at the start of ``part`` counts.
    """
    upto = W.partitionBy(*part).orderBy(*order)
    flips = (F.col("from_out") & ~F.col("from_in")).cast("int")
    df = df.withColumn("_f", F.sum(flips).over(upto.rowsBetween(W.unboundedPreceding, 0)))
    sets = F.when(F.col("from_out") == F.col("from_in"), F.col("from_out") != (F.col("_f") % 2 == 1))
    earlier = upto.rowsBetween(W.unboundedPreceding, -1)
    return df.withColumns({"flips": F.col("_f") - flips, "base": F.last(sets, ignorenulls=True).over(earlier)}).drop("_f")


def _state(start: Column) -> Column:
    return F.coalesce("base", start) != (F.col("flips") % 2 == 1)


def _cells(text: Column) -> Column:
    """The cells of a record."""
    def last_with(cells: Column, more: Column) -> Column:
        return F.concat(F.slice(cells, 1, F.size(cells) - 1), F.array(F.concat(F.element_at(cells, -1), more)))

    def put(acc: Column, part: Column) -> Column:
        pieces = F.split(part, ",", -1)
        spread = F.concat(last_with(acc["cells"], pieces[0]), F.slice(pieces, 2, F.size(pieces)))
        return F.when(acc["state"] == _INSIDE, last_with(acc["cells"], part)).otherwise(spread)

    def step(acc: Column, part: Column) -> Column:
        state, new = acc["state"], _after_quote(acc["state"], part)
        itself = (new == _PLAIN) | ((state == _CLOSED) & (part == ""))  # a quote that is text
        return F.struct(new.alias("state"), last_with(put(acc, part), F.when(itself, '"').otherwise("")).alias("cells")).cast(kind)

    kind = "struct<state:int,cells:array<string>>"
    parts = F.split(text, '"', -1)
    before = F.slice(parts, 1, F.size(parts) - 1)
    none = F.struct(F.lit(_START).alias("state"), F.array(F.lit("")).alias("cells")).cast(kind)
    quoted = F.aggregate(before, none, step, lambda acc: put(acc, F.element_at(parts, -1)))
    return F.when(F.contains(text, F.lit('"')), quoted).otherwise(F.split(text, ",", -1))


def records(lines: DataFrame) -> DataFrame:
    """(file, row_idx, cells, broken) of each record of (file, split, pos, value) lines; ``cells`` is null if quotes stay open.

    A record ends at a line break outside quotes; lines of white space are no records. ``broken`` marks text that is not UTF-8.
    Lines are shuffled once, by (file, split); only records of several lines once more.
    """
    first = (F.col("split") == 0) & (F.row_number().over(W.partitionBy("file", "split").orderBy("pos")) == 1)
    # A carriage return ends a line too, alone or before the line feed.
    crlf = F.col("value").endswith("\r")
    body = F.when(crlf, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    cut = lines.withColumns({"broken": ~F.is_valid_utf8("value"), "_first": first, "_end": F.when(crlf, F.lit("\r\n")).otherwise("\n"), "_body": body})
    cut = cut.withColumn("_body", F.when(F.col("_first"), F.regexp_replace("_body", "^\ufeff", "")).otherwise(F.col("_body")))
    parts = F.split("_body", "\r", -1)
    cut = cut.select("file", "split", "pos", "broken", "_end", F.size(parts).alias("_n"), F.posexplode(parts).alias("sub", "value"))
    cut = cut.withColumn("sep", F.when(F.col("sub") + 1 < F.col("_n"), F.lit("\r")).otherwise(F.col("_end"))).drop("_n", "_end")
    mapped = cut.withColumns({"from_out": _ends_inside(F.col("value"), _START), "from_in": _ends_inside(F.col("value"), _INSIDE)})
    known = _before(mapped, ["file", "split"], ["pos", "sub"])

    # What each split does, if it starts outside or inside quotes: the row after its last line.
    place = F.struct("pos", "sub")
    last = F.max_by(F.struct("base", "flips", "from_out", "from_in"), place)
    splits = known.groupBy("file", "split").agg(last.alias("l")).select("file", "split", "l.*")
    after = lambda start: F.when(_state(F.lit(start)), F.col("from_in")).otherwise(F.col("from_out"))
    splits = splits.select("file", "split", after(False).alias("from_out"), after(True).alias("from_in"))
    splits = _before(splits, ["file"], ["split"]).withColumn("start", _state(F.lit(False)))
    end = F.when(F.col("start"), F.col("from_in")).otherwise(F.col("from_out"))
    splits = splits.withColumn("open", F.max_by(end, "split").over(W.partitionBy("file"))).select("file", "split", "start", "open")

    lined = known.join(splits, ["file", "split"]).withColumn("inside", _state(F.col("start")))
    ends_inside = F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out"))
    lined = lined.select("file", "split", "pos", "sub", "broken", "value", "sep", "open", "inside", ends_inside.alias("goes_on"))
    kept = ~F.col("inside") & (F.col("goes_on") | (F.trim(F.translate("value", "\t\x0b\x0c", "   ")) != ""))
    upto = W.partitionBy("file", "split").orderBy("pos", "sub").rowsBetween(W.unboundedPreceding, 0)
    lined = lined.withColumns({"kept": kept, "own": F.sum(kept.cast("bigint")).over(upto)})
    counts = lined.groupBy("file", "split").agg(F.sum(F.col("kept").cast("bigint")).alias("n"))
    earlier = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_earlier"))
    placed = lined.join(counts, ["file", "split"]).withColumn("row_idx", (F.col("_earlier") + F.col("own") - 1).cast("int"))
    placed = placed.filter("kept OR inside").withColumn("text", F.when(~F.col("open"), F.col("value")))

    single = placed.filter("NOT inside AND NOT goes_on").select("file", "row_idx", "broken", "text")
    pieces = F.array_sort(F.collect_list(F.struct("split", "pos", "sub", "text", "sep")))
    several = placed.filter("inside OR goes_on").groupBy("file", "row_idx").agg(F.max("broken").alias("broken"), pieces.alias("p"))
    joined = F.array_join(F.transform("p", lambda p: F.concat(p["text"], p["sep"])), "")
    ending = F.length(F.element_at("p", -1)["sep"])
    several = several.select("file", "row_idx", "broken", F.when(F.element_at("p", 1)["text"].isNotNull(), F.substring(joined, F.lit(1), F.length(joined) - ending)).alias("text"))
    text = F.col("text")
    empty = lambda c: F.when(c.isin(EMPTY_WORDS), "").otherwise(c)
    return single.unionByName(several).select(
        "file", "row_idx", F.transform(_cells(text), empty).alias("cells"), "broken")


def scan_roster_grid(lines: DataFrame, max_cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(grid lines, files) of the lines of CSV files: (file, sheet_no, row_idx, cells) and (file, reason).

    A file is unreadable if it has no record, if it is not UTF-8, if quotes stay open at its end, or if a record is longer than the first one;
    shorter records are filled up. ``reason`` is null where a file was read. The records are written once to the shared folder.
    """
    path = shared_dir(lines.sparkSession, "records")
    records(lines).write.parquet(path)
    found = lines.sparkSession.read.parquet(path)
    n = F.size("cells")
    files = found.groupBy("file").agg(F.min_by(n, "row_idx").alias("width"), F.max(n).alias("most"), F.count(F.lit(1)).alias("rows"),
                                      F.max(F.col("cells").isNull() | F.col("broken")).alias("bad"))
    cells = F.col("rows") * F.col("width")
    large = F.when(cells > max_cells, _too_many(cells, max_cells)) if max_cells is not None else F.lit(None).cast("string")
    files = files.withColumn("reason", F.when(F.col("bad") | (F.col("most") > F.col("width")), UNREADABLE).otherwise(large))
    good = found.join(files.filter("reason IS NULL").select("file", "width"), "file")
    fill = F.array_repeat(F.lit(""), F.col("width") - n)
    return good.select("file", F.lit(0).alias("sheet_no"), "row_idx", F.concat("cells", fill).alias("cells")), files.select("file", "reason")


def guard_cells(lines: DataFrame, max_cells: int) -> DataFrame:
    """(file, reason) of files with more cells than ``max_cells``, counted as rows times width of each sheet."""
    per_sheet = lines.groupBy("file", "sheet_no").agg((F.count(F.lit(1)) * F.max(F.size("cells"))).alias("n"))
    too_big = per_sheet.groupBy("file").agg(F.sum("n").alias("n")).filter(F.col("n") > max_cells)
    return too_big.select("file", _too_many(F.col("n"), max_cells).alias("reason"))


def _low(c: Column) -> Column:
    return F.lower(strip(c))


def _positions(cells: Column, test) -> Column:
    found = F.transform(cells, lambda c, i: F.when(test(c), i))
    return F.array_compact(found)


def _is_day(c: Column) -> Column:
    return _low(c).rlike(DAY_CELL)


def detect_header(lines: DataFrame) -> DataFrame:
    """(file, header) of the files with a header: struct(sheet_no, row_idx, day_cols) of the first row with ten or more weekday cells."""
    days = lines.select("file", "sheet_no", "row_idx", _positions(F.col("cells"), _is_day).alias("days"))
    hits = days.filter(F.size("days") >= dims.HEADER_MIN_DAYS)
    return hits.groupBy("file").agg(F.min(F.struct("sheet_no", "row_idx", F.slice("days", 1, 14).alias("day_cols"))).alias("header"))


def detect_meta_columns(lines: DataFrame, headers: DataFrame, header_only: bool = False) -> DataFrame:
    """``headers`` with ``meta``: struct(name, station, status, id) of column positions.

    Rows up to the header are scanned row by row; the first cell holding one of a role's keywords wins.
    The scan is loose (``id`` also hits ``friday``); ``header_only`` looks at the header row alone, which is
    what re-reading an exported schedule needs.
    """
    h = F.col("header")
    row = (F.col("row_idx") == h["row_idx"]) if header_only else (F.col("row_idx") <= h["row_idx"])
    above = lines.join(headers, "file").filter((F.col("sheet_no") == h["sheet_no"]) & row)

    def position(role: str) -> Column:
        words = "|".join(w.replace(".", r"\.") for w in dims.META_KEYWORDS[role])
        return F.get(_positions(F.col("cells"), lambda c: _low(c).rlike(words)), F.lit(0))
    seen = above.select("file", "row_idx", *[position(role).alias(role) for role in dims.META_KEYWORDS])
    found = seen.groupBy("file").agg(F.struct(*[
        F.min_by(role, F.when(F.col(role).isNotNull(), F.col("row_idx"))).alias(role) for role in dims.META_KEYWORDS]).alias("meta"))
    return headers.join(found, "file")


def parse_roster_rows(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Employees below the header: (roster_id, row_idx, name, station, emp_status, id_no, codes).

    ``files`` has header and meta columns of each file; it has one small row for each.
    """
    h, m = F.col("header"), F.col("meta")
    known = files.filter(m["name"].isNotNull())
    rows = lines.join(known, "file").filter((F.col("sheet_no") == h["sheet_no"]) & (F.col("row_idx") > h["row_idx"]))
    cells = F.col("cells")

    def cell(i: Column) -> Column:
        return strip(F.coalesce(F.get(cells, i), F.lit("")))

    def code(i: Column) -> Column:
        up = F.upper(cell(F.get(h["day_cols"], i)))
        return F.when(up == "NAN", "").otherwise(F.coalesce(lookup(dims.CODE_ALIASES, up), up))

    def meta(role: str) -> Column:
        v = F.when(m[role].isNull(), "").otherwise(cell(m[role]))
        return F.when(v == "NAN", "").otherwise(v)
    name = cell(m["name"])
    out = rows.select(
        F.col("file").alias("roster_id"), "row_idx", name.alias("name"),
        meta("station").alias("station"), meta("status").alias("emp_status"), meta("id").alias("id_no"),
        F.transform(F.sequence(F.lit(0), F.lit(13)), code).alias("codes"))
    skipped = F.lower("name").isin(*dims.SKIPPED_NAMES) | F.col("name").startswith("=") | F.lower("name").rlike(DATE_NAME)
    skipped = skipped | F.forall("codes", lambda c: F.lower(c).rlike(DAY_CELL))  # the header once more
    return out.filter(~skipped)


def rejects(files: DataFrame, scanned: DataFrame, known: DataFrame) -> DataFrame:
    """(file, reason) of files without employees: guarded ones, unreadable ones, then those without days or names.

    ``files`` are guarded files, ``scanned`` those of the scan, ``known`` has header and meta columns. A file that may be
    read and has no record is unreadable, and so are workbooks here.
    """
    scanned = scanned.select("file", F.col("reason").alias("_scan"), F.lit(True).alias("_read"))
    all_ = files.select("file", "reason").join(scanned, "file", "left").join(known.select("file", "header", "meta"), "file", "left")
    reason = F.coalesce("reason", F.when(F.col("_read").isNull(), UNREADABLE), "_scan",
                        F.when(F.col("header").isNull(), NO_DAYS).when(F.col("meta.name").isNull(), NO_NAME))
    return all_.select("file", reason.alias("reason")).filter(F.col("reason").isNotNull())


def parse_files(spark: SparkSession, path: str, header_only: bool = False, max_bytes: int | None = None,
                max_cells: int | None = None, name: str = FILE_NAME) -> tuple[DataFrame, DataFrame]:
    """(roster, rejects) of the files under ``path``. Workbooks (.xls*) are not decoded: convert them to CSV, or pass
    their cells to `parse_cells`. Files over ``max_bytes`` are listed but not opened."""
    files = guard_files(list_files(spark, path, name), max_bytes)
    # Files may be many and small, and opening one costs more than its lines: each is opened once.
    lines, scanned = scan_roster_grid(written(read_text(spark, path, name, max_bytes), "lines"), max_cells)
    known = detect_meta_columns(lines, detect_header(lines), header_only)
    return parse_roster_rows(lines, known), rejects(files, scanned, known)


def parse_cells(lines: DataFrame, header_only: bool = False) -> DataFrame:
    """The roster of grid lines (file, sheet_no, row_idx, cells) from elsewhere, for example the sheets of workbooks."""
    return parse_roster_rows(lines, detect_meta_columns(lines, detect_header(lines), header_only))
