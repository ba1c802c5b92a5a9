"""Uploaded files on disk -> rosters and rejects."""

import csv
import io
import random

import pytest

from shiftledger import dims
from shiftledger.operators.rules import validate
from shiftledger.sources import grid as G
from shiftledger.sources import sinks
from shiftledger.streaming import arrival
from shiftledger.streaming.arrival import ingest_files

HEAD = "Station/Designation,Employee Status,ID NO.,Operator's Name:,Mon,Tue,Wed,Thu,Fri,Sat,Sun,SPACER,Mon,Tue,Wed,Thu,Fri,Sat,Sun"


def line(name, codes="A A A A A A RD A A A A A A RD", station="S1"):
    c = codes.split()
    return ",".join([station, "Reg", "7", name, *c[:7], "", *c[7:]])


def write(folder, name, text, raw=None):
    (folder / name).write_bytes(raw if raw is not None else text.encode())


def parse(spark, folder, limits=(None, None), **kw):
    roster, bad = G.parse_files(spark, str(folder), max_bytes=limits[0], max_cells=limits[1], **kw)
    return ({(r.roster_id.rsplit("/", 1)[-1], r.row_idx): r for r in roster.collect()},
            {r.file.rsplit("/", 1)[-1]: r.reason for r in bad.collect()})


def test_files(spark, tmp_path):
    good = "\n".join([HEAD, line('"Cruz, Ana"'), "", "   ", line("Marcelo", "as LEAVE cs bs NAN xx rd a b c aot bot cot os5"), line("12/01"),
                      line("2025-01-12"), line("Jan 12 2025"), line("May-5"), line("=A1"), line("Operator's Name"), line("None"),
                      line("Januario"), line("May Santos"), line("June Cruz"), line("NA")]) + "\n"
    write(tmp_path, "good.csv", good)
    write(tmp_path, "quoted.csv", HEAD + "\n" + line('"Two\nLines"') + "\n" + line("After") + "\n")
    write(tmp_path, "ragged.csv", "a,b\n" + HEAD + "\n" + line("X") + "\n")
    write(tmp_path, "latin.csv", "", raw=(HEAD + "\n" + line("Niño") + "\n").encode("latin-1"))
    write(tmp_path, "noheader.csv", "a,b\n1,2\n")
    write(tmp_path, "noname.csv", HEAD.replace("Operator's Name:", "Who") + "\n" + line("X") + "\n")
    write(tmp_path, "fake.xlsx", "not a workbook")
    write(tmp_path, "note.txt", "hello")
    write(tmp_path, "big.csv", "x" * (dims.MAX_FILE_BYTES + 1))
    write(tmp_path, "cells.csv", ("," * 999 + "x\n") * 501)
    write(tmp_path, "blank.csv", "\n  \n\t\r\n")
    write(tmp_path, "open.csv", HEAD + "\n" + line('"Ana') + "\n" + line("Bea") + "\n")
    rows, bad = parse(spark, tmp_path, (dims.MAX_FILE_BYTES, dims.MAX_FILE_CELLS))
    names = [r.name for (f, _), r in sorted(rows.items()) if f == "good.csv"]
    assert names == ["Cruz, Ana", "Marcelo", "Januario", "May Santos", "June Cruz"]
    marcelo = next(r for r in rows.values() if r.name == "Marcelo")
    assert marcelo.codes == ["A", "Leave", "C", "B", "", "XX", "RD", "A", "B", "C", "AOT", "BOT", "COT", "OS5"]
    assert (marcelo.station, marcelo.emp_status, marcelo.id_no) == ("S1", "Reg", "7")
    assert [r.name for (f, _), r in sorted(rows.items()) if f == "quoted.csv"] == ["Two\nLines", "After"]
    assert bad == {
        "blank.csv": G.UNREADABLE, "open.csv": G.UNREADABLE, "ragged.csv": G.UNREADABLE, "latin.csv": G.UNREADABLE, "noheader.csv": G.NO_DAYS, "noname.csv": G.NO_NAME,
        "fake.xlsx": G.BAD_XLSX, "note.txt": "Unsupported extension: .txt. Upload .xlsx, .xls, or .csv.", "big.csv": G.TOO_LARGE,
        "cells.csv": "File rejected: workbook contains 501,000 cells, which exceeds the 500,000-cell safety limit."}


def test_ten_to_thirteen_days_and_extra_days(spark, tmp_path):
    write(tmp_path, "ten.csv", "Name,Mon,Tue,Wed,Thu,Fri,Sat,Sun,Mon,Tue,Wed\nAna," + ",".join(["A"] * 10) + "\n")
    write(tmp_path, "more.csv", "Name," + ",".join(["Mon"] * 16) + "\nAna," + ",".join(["A"] * 14 + ["B", "B"]) + "\n")
    rows, bad = parse(spark, tmp_path)
    codes = {f: r.codes for (f, _), r in rows.items()}
    assert bad == {} and codes["ten.csv"] == ["A"] * 10 + [""] * 4 and codes["more.csv"] == ["A"] * 14


def test_loose_and_strict_meta_scan(spark, tmp_path):
    write(tmp_path, "t.csv", "VALIDATED SCHEDULE" + "," * 18 + "\n" + HEAD + "\n" + line("Ana") + "\n")
    loose, _ = parse(spark, tmp_path)
    strict, _ = parse(spark, tmp_path, header_only=True)
    assert next(iter(loose.values())).id_no == "S1" and next(iter(strict.values())).id_no == "7"


def test_sheets_from_cells(spark):
    head = HEAD.split(",")
    rows = [("w", 0, 0, ["nothing", "here"]), ("w", 1, 0, head), ("w", 1, 1, line("Ana").split(",")), ("w", 2, 0, head), ("w", 2, 1, line("Bea").split(","))]
    cells = spark.createDataFrame(rows, "file string, sheet_no int, row_idx int, cells array<string>")
    assert [r.name for r in G.parse_cells(cells).collect()] == ["Ana"]


def test_schedule_round_trip(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src, "r.csv", HEAD + "\n" + line("Ana") + "\n" + line("Bea", "AOT AOT AOT AOT RD RD RD AOT AOT AOT AOT RD RD RD") + "\n")
    roster, _ = G.parse_files(spark, str(src))
    results = validate(roster.withColumn("roster_id", roster.roster_id.substr(-5, 5)))
    out = str(tmp_path / "out")
    sinks.export_schedule(results, out)
    written = spark.read.text(out, recursiveFileLookup=True).collect()
    back = tmp_path / "back"
    back.mkdir()
    write(back, "r.csv", "\n".join([sinks.schedule_header_line(), *[r.value for r in written]]) + "\n")
    again, bad = parse(spark, back, header_only=True)
    assert bad == {} and sorted((r.name, r.codes) for r in again.values()) == sorted(
        (r.name, r.codes) for r in roster.collect())


def test_large_files_and_cells_are_read_unless_a_limit_is_set(spark, tmp_path):
    write(tmp_path, "long.csv", HEAD + "\n" + line("Ana", station="x" * 140_000) + "\n")
    write(tmp_path, "large.csv", HEAD + "\n" + "".join(line(f"Emp{k}", station="s" * 250) + "\n" for k in range(24_000)))
    assert (tmp_path / "large.csv").stat().st_size > dims.MAX_FILE_BYTES
    rows, bad = parse(spark, tmp_path)
    assert bad == {} and len(rows) == 24_001
    assert next(r for r in rows.values() if r.name == "Ana").station == "x" * 140_000


def test_records_match_a_csv_reader_however_the_file_is_split(spark, tmp_path):
    """Quotes, doubled quotes, quotes inside text, line breaks of all kinds; splits of 97 bytes fall anywhere."""
    r = random.Random(5)
    bits = ['"', '""', ",", "a", "b c", "\n", "\r\n", "\r", '",', ',"', '"\n', "\n\"", "é", " ", "long cell " * 9]
    texts = ["".join(r.choices(bits, k=r.randint(1, 60))) for _ in range(120)]
    texts += ['\ufeff"x\n\ny",1\n2,3\n', "a" * 500 + "\n" + '"' + "b\n" * 200 + '",c\n', 'say "hi", 5" pipe\n"q"x"y",z\n']
    for k, t in enumerate(texts):
        write(tmp_path, f"f{k}.csv", "", raw=t.encode())
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = G.read_text(spark, str(tmp_path))
        assert lines.groupBy("file", "split").count().count() > len(texts)
        got = {}
        for x in G.records(lines).collect():
            got.setdefault(int(x.file.rsplit("/f", 1)[-1][:-4]), []).append((x.row_idx, x.cells))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    clear = lambda row: ["" if c in G.EMPTY_WORDS else c for c in row]
    for k, t in enumerate(texts):
        t = t.removeprefix("\ufeff")
        rows = sorted(got.get(k, []))
        assert [i for i, _ in rows] == list(range(len(rows)))
        if any(c is None for _, c in rows):  # quotes are open at the end: the reader below takes in what follows
            assert csv.reader(io.StringIO(t + "\nEND,END", newline="")) and "END,END" in list(csv.reader(io.StringIO(t + "\nEND,END", newline="")))[-1][-1]
            continue
        want = []
        for row in csv.reader(io.StringIO(t, newline="")):
            if row and not (len(row) == 1 and not row[0].strip(" \t\x0b\x0c")):
                want.append(clear(row))
        # A quoted cell that is blank is a record; the reader's rows do not tell it from a blank line.
        assert [c for _, c in rows if not (len(c) == 1 and not c[0].strip(" \t\x0b\x0c"))] == want, (t, rows)


def test_a_large_file_is_parsed_by_several_tasks_without_python(spark, tmp_path):
    write(tmp_path, "large.csv", HEAD + "\n" + "".join(line(f'"Emp\n{k}"', station="s" * 460) + "\n" for k in range(40_000)))
    assert (tmp_path / "large.csv").stat().st_size > 18_000_000
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
        lines = G.read_text(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() >= 8
        recs = G.records(lines)
        plan = recs._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
        assert recs.count() == 40_001
        roster, bad = G.parse_files(spark, str(tmp_path))
        assert bad.count() == 0 and roster.count() == 40_000
        assert roster.agg({"row_idx": "max"}).first()[0] == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_arrive_in_batches_with_a_restart_between(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    write(src, "a.csv", HEAD + "\n" + line("Ana") + "\n" + line("Bea", "A " * 13 + "A") + "\n")
    write(src, "b.csv", "a,b\n1,2\n")
    write(src, "c.xlsx", "not a workbook")
    accepted, rejected = ingest_files(spark, str(src), out, files_per_batch=2)
    first = sorted((r.name, r.Status) for r in accepted.collect())
    assert first == [("Ana", "Valid"), ("Bea", "Invalid")]
    assert {r.file.rsplit("/", 1)[-1]: r.reason for r in rejected.collect()} == {"b.csv": G.NO_DAYS, "c.xlsx": G.BAD_XLSX}
    # The last batch fails after it has written: its commit is lost, and so it runs again.
    commits = sorted((tmp_path / "out" / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    write(src, "d.csv", HEAD + "\n" + line("Cid") + "\n")
    accepted, rejected = ingest_files(spark, str(src), out, files_per_batch=2)
    assert sorted(r.name for r in accepted.collect()) == ["Ana", "Bea", "Cid"] and rejected.count() == 2
    again, _ = ingest_files(spark, str(src), out)
    assert again.count() == 3


def test_what_has_landed_is_parsed_at_once_and_after_a_failure_again(spark, tmp_path, monkeypatch):
    src, out, calls = tmp_path / "in", str(tmp_path / "out"), []
    for k, name in enumerate("abcd"):  # all have one name, in four batches
        (src / name).mkdir(parents=True)
        write(src / name, "r.csv", HEAD + "\n" + line(f"Emp{k}") + "\n")

    def counted(lines, *limits):
        calls.append(lines)
        if len(calls) == 1:
            raise RuntimeError("lost between landing and parsing")
        return parse_batch(lines, *limits)

    parse_batch = arrival.parse_batch
    monkeypatch.setattr(arrival, "parse_batch", counted)
    name = "element_at(split(_metadata.file_path, '/'), -1)"
    with pytest.raises(RuntimeError):
        ingest_files(spark, str(src), out, name=name, files_per_batch=1)
    accepted, rejected = ingest_files(spark, str(src), out, name=name, files_per_batch=1)
    assert len(calls) == 2 and rejected.count() == 0
    assert sorted((r.roster_id, r.row_idx, r.name) for r in accepted.collect()) == [("r.csv", 1, f"Emp{k}") for k in range(4)]


def test_files_are_opened_once_and_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    write(tmp_path, "a.csv", HEAD + "\n" + line("Ana") + "\n" + HEAD + "\n")
    setting, seen, records = "spark.sql.sources.parallelPartitionDiscovery.parallelism", [], G.records
    monkeypatch.setattr(G, "records", lambda lines: seen.append(lines._jdf.queryExecution().executedPlan().toString()) or records(lines))
    rows, bad = parse(spark, tmp_path)
    assert [r.name for r in rows.values()] == ["Ana"] and bad == {}  # a header that comes again is no employee
    assert len(seen) == 1 and "FileScan parquet" in seen[0] and "FileScan text" not in seen[0]
    old = spark.conf.get(setting)
    with G.listing(spark):
        assert int(spark.conf.get(setting)) == min(int(old), int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert spark.conf.get(setting) == old
