"""Files of several headers, the log of processed files, restores from files, and the audit log."""

from __future__ import annotations

import hashlib
import os
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from barwright.operators.audit import AuditLog, feed_problem_events, invalid_row_events, save_raw
from barwright.operators.ingest import create_snapshots, ingest_csv_folder, latest_snapshot_rows
from barwright.operators.integrity import verify_restores
from barwright.operators.quality import annotate
from barwright.operators.retention import prune
from barwright.sources.files import (
    ARROW_SCHEMES,
    NoFileSystem,
    _file_system,
    copy_files,
    facts_of,
    file_facts,
    listed_files,
    remove_files,
    write_csv_folders,
)
from barwright.sources.log import ProcessedFiles, RunLog
from barwright.sources.prices import header_columns, header_groups, headers_of, read_grouped_csv, read_small_csv
from barwright.sources.table import YearTable
from barwright.streaming.ingest import counted_files, quarantined, start_ingest

AS_OF = datetime(2024, 1, 31)
HEADER = "ticker,date,open,high,low,close,volume,source,fetched_at,raw_checksum"


def write(folder, name, header, *lines):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_text("\n".join([header, *lines]) + "\n")


def closes(table):
    return {(r.ticker, str(r.date)): r.close for r in table.read().collect()}


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in" / "box [1] {2}"  # a name that would be a pattern
    write(folder, "a.csv", HEADER, "AAAA3,2023-01-02,1,2,1,1.5,100,desk,,", "AAAA3,2023-01-03,1,2,1,1.6,100,desk,,")
    write(folder, "b.csv", "Close, volume ,LOW,high,open,note,Date,Ticker", '2.5,7,1,3,1,"x, y",2023-01-02,bbbb3.sa', "2.6,7,1,3,1,x,2023-01-03")
    write(folder, "c.csv", "what,is,this", "1,2,3")
    write(folder, "d.csv", "ticker,date,close,close", "DDDD3,2023-01-02,1,2")
    (folder / "e.csv").write_bytes(b"\xff\xfe\x00t,date\n")
    (folder / "f.csv").write_bytes("\ufeff".encode() + f"{HEADER}\nFFFF3,2023-01-02,1,2,1,4.5,100,desk,,\n".encode())
    return folder


EXPECTED = {
    "a.csv": ("ingest", None, 2, 2, 0), "b.csv": ("ingest", None, 2, 1, 1), "c.csv": ("bad_header", "header lacks ticker, date", 0, 0, 0),
    "d.csv": ("bad_header", "header repeats close", 0, 0, 0), "e.csv": ("bad_header", "header is no text", 0, 0, 0), "f.csv": ("ingest", None, 1, 1, 0),
}
CLOSES = {("AAAA3", "2023-01-02"): 1.5, ("AAAA3", "2023-01-03"): 1.6, ("BBBB3", "2023-01-02"): 2.5, ("FFFF3", "2023-01-02"): 4.5}


def report(result):
    return {r.path.rsplit("/", 1)[1]: (r.decision, r.reason, r.rows, r.processed_rows, r.invalid_rows) for r in result.report.collect()}


def test_every_file_is_read_by_its_own_header(spark, tmp_path, inbox):
    table, processed = YearTable(spark, f"{tmp_path}/prices"), ProcessedFiles(spark, f"{tmp_path}/processed")
    assert processed.newest().count() == 0
    result = ingest_csv_folder(spark, str(inbox.parent), table, processed, f"{tmp_path}/w1", AS_OF)
    assert report(result) == EXPECTED
    assert closes(table) == CLOSES
    assert {r.path.rsplit("/", 1)[1] for r in processed.newest().collect()} == {"a.csv", "b.csv", "f.csv"}


def test_a_second_run_opens_only_what_was_refused(spark, tmp_path, inbox):
    table, processed = YearTable(spark, f"{tmp_path}/prices"), ProcessedFiles(spark, f"{tmp_path}/processed")
    ingest_csv_folder(spark, str(inbox.parent), table, processed, f"{tmp_path}/w1", AS_OF)
    for name in ("a.csv", "b.csv", "f.csv"):  # other bytes of the same size and time: only a look inside would notice
        at = os.stat(inbox / name)
        (inbox / name).write_bytes(b"?" * at.st_size)
        os.utime(inbox / name, ns=(at.st_atime_ns, at.st_mtime_ns))
    again = report(ingest_csv_folder(spark, str(inbox.parent), table, processed, f"{tmp_path}/w2", AS_OF))
    assert {n: d for n, (d, *_) in again.items()} == {n: "cached" if d == "ingest" else d for n, (d, *_) in EXPECTED.items()}
    opened = {r.path.rsplit("/", 1)[1] for r in spark.read.parquet(f"{tmp_path}/w2/facts").collect()}
    assert opened == {"c.csv", "d.csv", "e.csv"}
    assert closes(table) == CLOSES


def test_a_touched_file_is_hashed_but_not_parsed_and_a_stale_one_is(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.csv", HEADER, "AAAA3,2023-01-02,1,2,1,1.5,100,desk,,")
    table, processed = YearTable(spark, f"{tmp_path}/prices"), ProcessedFiles(spark, f"{tmp_path}/processed")
    version = ingest_csv_folder(spark, str(folder), table, processed, f"{tmp_path}/w1", AS_OF).version
    os.utime(folder / "a.csv", (2e9, 2e9))
    again = ingest_csv_folder(spark, str(folder), table, processed, f"{tmp_path}/w2", AS_OF)
    assert report(again) == {"a.csv": ("cached", None, 0, 0, 0)} and again.version == version
    third = ingest_csv_folder(spark, str(folder), table, processed, f"{tmp_path}/w3", AS_OF)
    assert not os.path.exists(f"{tmp_path}/w3/facts") and report(third)["a.csv"][0] == "cached"  # its new time is known now
    late = datetime(2024, 3, 1)
    stale = ingest_csv_folder(spark, str(folder), table, processed, f"{tmp_path}/w4", late, ttl_seconds=60)
    assert report(stale) == {"a.csv": ("ingest", None, 1, 0, 0)}


def test_a_stream_goes_on_past_strange_files(spark, tmp_path, inbox):
    table, processed = YearTable(spark, f"{tmp_path}/prices"), ProcessedFiles(spark, f"{tmp_path}/processed")
    for n in range(2):
        start_ingest(
            spark, str(inbox.parent), table, f"{tmp_path}/check", f"{tmp_path}/work", AS_OF, files_per_batch=4, processed=processed
        ).awaitTermination()
        assert closes(table) == CLOSES
        if n == 0:
            write(inbox, "g.csv", "date,ticker,open,high,low,close,volume", "2023-01-04,AAAA3,1,2,1,1.7,100")
            CLOSES[("AAAA3", "2023-01-04")] = 1.7
    del CLOSES[("AAAA3", "2023-01-04")]
    assert quarantined(spark, f"{tmp_path}/work").count() == 1
    assert processed.newest().count() == 4
    assert processed.read().select("run").distinct().count() >= 2


def test_headers():
    assert header_columns('"date","Ticker"') == (["date", "ticker"], None)
    assert header_columns("") == ([], "header lacks ticker, date")
    assert header_columns(None)[1] == "header is no text"


def test_a_run_that_is_repeated_replaces_its_entries(spark, tmp_path):
    log = RunLog(spark, f"{tmp_path}/log", "a int")
    assert log.read().count() == 0
    log.record("x/1", spark.range(3).selectExpr("cast(id as int) a"))
    log.record("2024-01-01", spark.range(1).selectExpr("7 as a"))
    log.record("x/1", spark.range(2).selectExpr("cast(id as int) a"))
    assert sorted(r.a for r in log.read().collect()) == [0, 1, 7]


def test_facts_of_small_and_streamed_files(spark, tmp_path, monkeypatch):
    from barwright.sources import files

    data = {"a.txt": b"one\ntwo\n", "b.txt": b"\n", "c.txt": b"x" * 70_000, "d.txt": "é,ü\r\n1".encode()}
    folder = tmp_path / "f"
    folder.mkdir()
    for name, held in data.items():
        (folder / name).write_bytes(held)

    def found():
        facts = file_facts(spark, str(folder)).collect()
        return {r.path.rsplit("/", 1)[1]: (r.sha256, r.header[:70_000], r.error) for r in facts}

    whole = found()
    assert {n: h for n, (h, _, _) in whole.items()} == {n: hashlib.sha256(d).hexdigest() for n, d in data.items()}
    assert whole["a.txt"][1] == "one" and whole["d.txt"][1] == "é,ü" and len(whole["c.txt"][1]) == files.HEADER_BYTES
    monkeypatch.setattr(files, "WHOLE_BYTES", -1)
    assert found() == whole


@pytest.mark.parametrize("path", ["wasbs://c@a.blob.core.windows.net/x", "dbfs:/x", "strange://x/y"])
def test_paths_without_a_file_system_are_errors_of_their_file(spark, path, tmp_path):
    with pytest.raises(NoFileSystem):
        _file_system(path)
    (tmp_path / "there").write_text("x")
    plan = spark.createDataFrame([(path, f"{tmp_path}/t"), (f"{tmp_path}/there", f"{tmp_path}/copy")], "path string, target string")
    outcome = {r.path: (r.sha256, r.error) for r in copy_files(plan, 1).collect()}
    assert "no file system" in outcome[path][1] and outcome[f"{tmp_path}/there"][1] is None
    assert [r.deleted for r in remove_files(plan.filter(F.col("path") == path), 1).collect()] == [False]


def test_schemes_of_the_same_store():
    assert _file_system("file:/a/b")[1] == "/a/b" and _file_system("file:///a/b")[1] == "/a/b"
    assert ARROW_SCHEMES["s3a"] == ARROW_SCHEMES["s3n"] == "s3"


def test_restores_are_judged_file_by_file(spark, tmp_path):
    header = "ticker,date,open,high,low,close,volume,adj_close"
    line = "AAAA3,2023-01-0{},1,2,1,1.5,100,1.5"
    folder = tmp_path / "snap"
    files = {
        "good.csv": [header, line.format(2), line.format(3)],
        "close_only.csv": [header.removesuffix(",adj_close"), "AAAA3,2023-01-02,1,2,1,1.5,100"],
        "lost_column.csv": ["ticker,date,open,high,low,volume", "AAAA3,2023-01-02,1,2,1,100"],
        "twice.csv": [header, line.format(2), line.format(2)],
        "no_key.csv": [header, ",2023-01-02,1,2,1,1.5,100,1.5", line.format(3)],
        "short.csv": [header, line.format(2), "AAAA3,2023-01-03"],
        "empty.csv": [header],
        "other_bytes.csv": [header, line.format(2)],
        "unknown.csv": [header, line.format(2)],
        "repeated.csv": [header + ",close", line.format(2) + ",1"],
    }
    for name, (head, *lines) in files.items():
        write(folder, name, head, *lines)
    digest = {n: hashlib.sha256((folder / n).read_bytes()).hexdigest() for n in files}
    digest |= {"other_bytes.csv": "0" * 64, "unknown.csv": None}
    listed = [(n, f"{folder}/{n}", len(files[n]) - 1, digest[n]) for n in files] + [("gone", f"{folder}/gone.csv", 1, "x"), ("no path", None, 1, "x")]
    catalog = spark.createDataFrame(listed, "id string, snapshot_path string, rows long, checksum string")
    found = {r.id: r for r in verify_restores(spark, catalog, str(folder), f"{tmp_path}/work").collect()}
    verdicts = {n: (r.overall, r.exit_code, r.columns_present, r.row_count, r.sample_row_check, r.checksum_match) for n, r in found.items()}
    good, bad = "pass", "fail"
    assert verdicts == {
        "good.csv": ("PASS", 0, good, good, good, good), "close_only.csv": ("PASS", 0, good, good, good, good),
        "lost_column.csv": ("FAIL", 2, bad, bad, bad, good), "twice.csv": ("FAIL", 2, good, bad, good, good),
        "no_key.csv": ("FAIL", 2, good, bad, good, good), "short.csv": ("FAIL", 2, good, bad, bad, good),
        "empty.csv": ("FAIL", 2, good, bad, bad, good), "other_bytes.csv": ("WARN", 1, good, good, good, bad),
        "unknown.csv": ("FAIL", 2, good, good, good, bad), "repeated.csv": ("FAIL", 2, good, bad, bad, good),
        "gone": ("FAIL", 2, bad, bad, bad, bad),
    }
    assert found["gone"].reason == "file is missing" and found["repeated.csv"].reason == "header repeats close" and found["good.csv"].reason is None
    assert found["short.csv"].rows_restored == 2


def test_the_latest_snapshots_list_one_generation(spark, bars, tmp_path):
    older = create_snapshots(spark, bars([("AAAA3", "2023-01-02", 1.0)]), f"{tmp_path}/0", datetime(2024, 1, 1))
    newer = create_snapshots(spark, bars([("AAAA3", "2023-01-02", 2.0)]), f"{tmp_path}/1", datetime(2024, 1, 2))
    other = create_snapshots(spark, bars([("BBBB3", "2023-01-02", 3.0)]), f"{tmp_path}/2", datetime(2024, 1, 1))
    older, newer, other = (spark.createDataFrame(c.collect(), c.schema) for c in (older, newer, other))
    found = latest_snapshot_rows(spark, older.unionByName(newer))
    assert [r.close for r in found.collect()] == [2.0]
    assert all("/1/snapshot/" in f for f in found.inputFiles())
    both = latest_snapshot_rows(spark, older.unionByName(newer).unionByName(other))
    assert sorted(r.close for r in both.collect()) == [2.0, 3.0]
    assert latest_snapshot_rows(spark, newer.limit(0)).count() == 0


def test_prune_orders_by_name_then_by_file_time_and_takes_sidecars(spark, tmp_path):
    folder = tmp_path / "s"
    names = ["A3-20240101T000000Z.csv", "A3-20240301T000000Z.csv", "A3-20249901T000000Z.csv", "A3-20249902T000000Z.csv", "strange.csv", "A3F-20200101T000000.csv"]
    for n, name in enumerate(names):
        write(folder, name, "x")
        (folder / f"{name}.checksum").write_text("y")
        os.utime(folder / name, (1.6e9 + n, 1.6e9 + n))
    write(folder / "other", names[0], "x")  # another folder keeps its own
    dry = prune(spark, str(folder), 3)
    assert [r.name for r in dry.collect()] == [names[2]] and len(list(folder.iterdir())) == 13
    assert [(r.ticker, r.deleted) for r in prune(spark, str(folder), 3, f"{tmp_path}/report").collect()] == [("A3", True)]
    assert prune(spark, str(folder), 3, f"{tmp_path}/report").count() == 0
    left = {p.name for p in folder.iterdir() if p.is_file()}
    assert left == {f"{n}{e}" for n in names if n != names[2] for e in ("", ".checksum")}
    prune(spark, str(folder), 1, f"{tmp_path}/report").collect()
    assert {r.path.rsplit("/", 1)[1] for r in listed_files(spark, str(folder), "*.csv", recursive=False).collect()} == {names[1], names[4], names[5]}


def test_audit_events(spark, bars, tmp_path):
    log = AuditLog(spark, f"{tmp_path}/log")
    frame = bars([("AAAA3", "2023-01-02", 1.0)]).withColumn("provider", F.lit("a b/c"))
    for stamp in ("20240101T000000Z", "20240101T000000Z", "20240102T000000Z"):
        raw = save_raw(spark, frame, f"{tmp_path}/raw", stamp, f"job-{stamp}", AS_OF)
        log.record(f"job-{stamp}", raw)
    pulls = log.events("raw_pull").collect()
    assert len(pulls) == 2 and {r.rows for r in pulls} == {1} and len({r.raw_file for r in pulls}) == 2
    for r in pulls:
        path = r.raw_file
        data = open(path, "rb").read()
        assert hashlib.sha256(data).hexdigest() == r.file_checksum and len(data) == r.size_bytes
        assert open(f"{path}.checksum").read().split()[0] == r.file_checksum
        assert r.provider == "a b/c" and r.ticker == "AAAA3" and r.created_at == AS_OF
    bad = annotate(frame.withColumn("high", F.lit(-1.0)).withColumn("n", F.lit(7)))
    event = invalid_row_events(bad, "j", AS_OF, "n", F.lit("in.csv"), F.lit("out.csv")).collect()[0]
    assert (event.invalid_count, event.raw_file, event.invalid_filepath, event.status) == (1, "in.csv", "out.csv", "error")
    assert [(d.row, d.reason_code) for d in event.error_details] == [("7", "CONSTRAINT_VIOLATION")]
    assert feed_problem_events(spark, frame, "j", AS_OF, "p").count() == 0
    problem = feed_problem_events(spark, frame.drop("close").limit(0), "j", AS_OF, "p", "AAAA3").collect()[0]
    assert [d.reason_code for d in problem.error_details] == ["ADAPTER_VALIDATION"] * 2 and problem.ticker == "AAAA3"
    log.record("bad", invalid_row_events(bad, "bad", AS_OF, "n"))
    assert rows(log.events(job_id="bad").select("kind", "invalid_count")) == [("invalid_rows", 1)]


def test_folders_of_small_files_are_those_that_spark_writes(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a/b=c%é ^[x]{", 1, " lead", 'x,"y'), (None, 2, None, ""), ("", 3, "l\n2", "ü"), ("p:q", 4, " ", " t "), ("p:q", 5, "z", None)],
        "k string, n int, s string, `t,u` string",
    ).repartition(1)
    for i, options in enumerate(({}, {"quoteAll": "true"})):
        rows.sortWithinPartitions("k", "n").write.partitionBy("k").options(header="true", maxRecordsPerFile="1", **options).csv(f"{tmp_path}/a{i}")
        write_csv_folders(rows, f"{tmp_path}/b{i}", ("k",), ("n",), 1, **options)

        def held(root):
            return sorted((str(f.parent.relative_to(root)), f.read_bytes()) for f in root.rglob("*.csv"))

        assert held(tmp_path / f"a{i}") == held(tmp_path / f"b{i}")
        assert not [f for f in (tmp_path / f"b{i}").rglob("*") if f.name.startswith(".")]
    with pytest.raises(FileExistsError):
        write_csv_folders(rows, f"{tmp_path}/b0", ("k",))


def test_lines_read_by_the_tasks_are_those_of_sparks_csv_source(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_bytes(
        b'ticker,date,close\nA,2020-01-01,1\n\n  \nB,2020\nC,2020-01-01,1,extra\n"q,1",x,"2\n D , e , \xff\n"",,\r\nE,1,2\rF,"a""b",3\n,,\n#c,1,2\n'
    )
    (folder / "b +%1.csv").write_bytes(b'\xef\xbb\xbfDate, Ticker ,no`te\n2020-01-02,B,"x, y"\n2020-01-03,C,\n')
    (folder / "b +%1.csv.checksum").write_bytes(b"ABC  b\n")
    facts = file_facts(spark, str(folder), "*.csv")
    own = facts_of(listed_files(spark, str(folder), "*.csv"), 2)
    assert facts.orderBy("path").collect() == own.drop("expected").orderBy("path").collect()
    assert [r.expected for r in own.orderBy("path").collect()] == [None, "abc"]
    order = ("_path", "_block", "_row")
    before = read_grouped_csv(spark, header_groups(facts)[0]).orderBy(*order).drop("_row").collect()
    after = read_small_csv(own.join(headers_of(own), "header"), tasks=2).orderBy(*order).drop("_row").collect()
    assert before == after and len(after) == 12


def test_folders_are_listed_and_hashed_by_tasks(spark, tmp_path, monkeypatch):
    """What Spark's own listing gives, without a file's path on the driver."""
    from barwright.sources import files
    from barwright.sources.files import file_hashes, sidecar_hashes

    root = tmp_path / "a b+%20"
    for n in range(3):
        for t in ("x", "y é", "_k=1", "_hidden", ".dot"):
            folder = root / f"{n}" / f"_t={n}%2F" / t / "deep"
            folder.mkdir(parents=True)
            (folder / "f.csv").write_text(f"date,ticker\n{n},{t}\n")
            (folder / "f.csv.checksum").write_text(f"\n AB{n}  f.csv\n")
            for name in ("_SUCCESS", ".f.csv", "empty.csv", "g.txt"):
                (folder / name).write_text("" if name == "empty.csv" else "x")
    (root / "top.csv").write_text("date\n")

    def found():
        listed = [sorted(tuple(r) for r in listed_files(spark, str(root), p).collect()) for p in ("*", "*.csv", "?.txt")]
        hashed = sorted(tuple(r) for r in file_hashes(spark, f"{root}/", "*.csv").collect())
        return listed, hashed, sorted(tuple(r) for r in sidecar_hashes(spark, str(root)).collect())

    def never(*_):
        raise AssertionError("listed on the driver")

    with monkeypatch.context() as m:
        m.setattr(files, "_files", never)
        own = found()
    monkeypatch.setattr(files, "listing_of", lambda *_: None)
    assert own == found() and len(own[0][1]) == 10 and len(own[2]) == 9
    assert {e for _, e in own[2]} == {"ab0", "ab1", "ab2"}


def test_lines_of_files_that_are_read_in_several_chunks(spark, tmp_path, monkeypatch):
    from io import BytesIO

    from barwright.sources import files

    data = "h\r\na,é\r\n\r\nb\rc\n\nd€\r".encode() + b"\xff\xe2\x82"
    whole = list(enumerate(__import__("re").split("\r\n|\n|\r", data.decode(errors="replace"))))
    for size in range(1, len(data) + 2):
        monkeypatch.setattr(files, "CHUNK", size)
        assert list(files._split(BytesIO(data))) == whole


def test_snapshots_are_read_by_tasks(spark, bars, tmp_path, monkeypatch):
    from barwright.sources import prices

    frame = bars([("AAAA3", "2023-01-02", 1.0), ("a/b=%+ é", "2023-01-02", 2.0), ("B,\"3", "2023-01-03", 3.0)])
    frame = frame.unionByName(frame.limit(1).withColumns({"date": F.lit("2023-05-05").cast("date"), "close": F.lit(None).cast("double"), "source": F.lit(None).cast("string")}))
    prices.write_snapshot(frame, f"{tmp_path}/g/snapshot", 1)
    folder = f"{tmp_path}/g/snapshot"
    wanted = spark.createDataFrame([(f"{folder}/_ticker=a/b=%+ é",)], "_folder string")

    def found():
        return rows(prices.read_snapshot(spark, folder)), rows(prices.read_generations(spark, [folder])), rows(prices.read_generations(spark, [folder], only=wanted))

    own = found()
    assert own[0] == rows(frame.select(*(f.name for f in prices.PRICES))) and len(own[2]) == 1
    monkeypatch.setattr(prices, "listing_of", lambda *_: None)
    assert own == found()


def test_a_stream_lists_its_files_in_few_tasks_and_stages_no_listing(spark, bars, tmp_path):
    from barwright.sources import files

    before = spark.conf.get(files.LISTING)
    own = files.listing_session(spark)
    assert own.conf.get(files.LISTING) == str(files.TASKS) and spark.conf.get(files.LISTING) == before
    for n in range(3):
        write(tmp_path / "in", f"{n}.csv", f"date,ticker,open,high,low,close,volume\n2023-01-0{n + 2},AAAA3,1,2,1,1.5,10\n")
    (tmp_path / "in" / "1.csv.checksum").write_text("ab  1.csv\n")
    prices = YearTable(spark, f"{tmp_path}/t")
    start_ingest(spark, f"{tmp_path}/in", prices, f"{tmp_path}/c", f"{tmp_path}/w", AS_OF, files_per_batch=2).awaitTermination()
    assert sorted(str(r.date) for r in prices.read().collect()) == ["2023-01-02", "2023-01-04"]  # the other's sidecar is wrong
    assert sorted(r.decision for r in counted_files(spark, f"{tmp_path}/w").collect()) == ["bad_checksum", "ingest", "ingest"]
    assert not os.path.exists(f"{tmp_path}/w/listing")
