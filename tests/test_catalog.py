from __future__ import annotations

import datetime as dt
import hashlib
import json
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from barwright.functions import dates, names, tickers, values
from barwright.operators.catalog import by_paths, latest_per_ticker, prune_list, purge_candidates, resolve_tickers
from barwright.operators.integrity import compare_manifests, restore_checks, verify_sidecars
from barwright.operators.joblog import search_log
from barwright.operators.retention import apply_repairs, archive_totals, purge, repair_plan
from barwright.sources.files import copy_files, file_hashes, load_manifest, read_manifest, sidecar_hashes, write_manifest

AS_OF = dt.datetime(2024, 2, 1)
CATALOG = "id string, ticker string, created_at timestamp, snapshot_path string, size_bytes long, checksum string, archived boolean, archived_at timestamp"


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "base"),
    [("petr4", "PETR4"), (" PETR4.SA ", "PETR4"), ("BOVA11", "BOVA11"), ("ABCD", None), ("AB1", None), ("", None),
     ("PETR4.SA.SA", None), ("ABCDEFGH9", None), (None, None)],
)
def test_ticker_rule(spark, text, base):
    assert one(spark, text, tickers.normalize_ticker) == base
    assert one(spark, text, tickers.provider_ticker) == (base and base + ".SA")
    assert (one(spark, text, tickers.ticker_error) is None) == (base is not None)


def test_other_ticker_forms(spark):
    assert one(spark, "petr4.SA.SA", tickers.lenient_ticker) == "PETR4.SA"
    assert one(spark, "PETR4.SA.SA", tickers.returns_ticker) == "PETR4"
    assert one(spark, "petr4", tickers.feed_ticker) == "PETR4.SA" and one(spark, "AAPL", tickers.feed_ticker) == "AAPL"


def test_dates_in_text(spark):
    assert one(spark, "01-31-2023", dates.feed_date) == dt.date(2023, 1, 31)
    assert one(spark, "2023/01/31", dates.feed_date) is None
    assert one(spark, "2023-1-5", dates.strict_iso_date) is None
    assert one(spark, "2023-02-30", dates.strict_iso_date) is None
    assert one(spark, "20230105", dates.dashed_date) == "2023-01-05" and one(spark, "soon", dates.dashed_date) == "soon"
    assert one(spark, "2023-01-05T23:00:00-03:00", dates.lenient_date) == dt.date(2023, 1, 6)
    assert one(spark, "20230101T000000Z", dates.is_compact_stamp) and not one(spark, "20230101", dates.is_compact_stamp)


@pytest.mark.parametrize(
    ("payload", "path", "expected"),
    [
        (None, "/srv/shots/20230101", ("2023-01-01", "")),
        ('{"start": "2023-01-01", "end_date": "20230102"}', "/x/2020-01-01", ("2023-01-01", "2023-01-02")),
        (None, "/s/2023-01-01_to_2023-01-02.csv", ("2023-01-01", "2023-01-02")),
        ("broken", "/s/20230101-2023-01-02", ("2023-01-01", "2023-01-02")),
        ("[1]", None, ("", "")),
    ],
)
def test_snapshot_range_and_id(spark, payload, path, expected):
    frame = spark.createDataFrame([("PETR4", payload, path)], "t string, p string, s string")
    start, end = dates.snapshot_range(F.col("p"), F.col("s"))
    row = frame.select(start.alias("a"), end.alias("b"), names.stable_snapshot_id(F.col("t"), F.col("p"), F.col("s")).alias("i")).first()
    assert (row.a, row.b) == expected
    assert row.i == hashlib.sha256("_".join(["PETR4", *expected]).encode()).hexdigest()


@pytest.mark.parametrize(
    ("name", "ticker", "suffix"),
    [("PETR4-20230101T120000.csv", "PETR4", None), ("PETR4.SA-20230101T120000Z.csv", "PETR4.SA", None),
     ("PETR4-20230101T120000-full.csv", "PETR4", "full"), ("petr4-20230101T120000.csv", None, None),
     ("PETR4_snapshot.csv", None, None), ("X_SA-20230101T120000.csv", None, None), ("PETR4-20230101.csv", None, None)],
)
def test_snapshot_names(spark, name, ticker, suffix):
    parts = one(spark, name, names.snapshot_name_parts)
    assert (parts and parts.ticker) == ticker and (parts.suffix if parts else None) == suffix


def test_flags(spark):
    assert [one(spark, v, values.strict_flag) for v in ("Yes", " off ", None, "maybe")] == [True, False, False, None]
    assert [one(spark, v, values.lenient_flag) for v in ("ON", "0", None)] == [True, False, False]


def test_keep_latest(spark):
    days = [f"PETR4-202301{d:02d}T000000.csv" for d in range(1, 6)]
    files = spark.createDataFrame([(n,) for n in [*days, "PETR4F-20230101T000000.csv", "PETR4_snapshot.csv"]], "name string")
    assert [r[2] for r in rows(prune_list(files, 2))] == days[:3]
    assert len(rows(prune_list(files, 0))) == 4  # one file is always kept


def entries(spark, *data):
    return spark.createDataFrame(data, CATALOG)


def entry(id, days_old=0, path="/data/x.csv", checksum="c", archived=False, ticker="PETR4"):
    return (id, ticker, AS_OF - dt.timedelta(days=days_old), path, 1, checksum, archived, None)


def test_latest_and_purge(spark):
    catalog = entries(spark, entry("a", 100), entry("b", 5), entry("c", 100, archived=True), entry("d", 100, None), entry("e", 5))
    assert latest_per_ticker(catalog).first().id == "e"
    assert [r.id for r in purge_candidates(catalog, 90, AS_OF).collect()] == ["a"]
    with pytest.raises(ValueError):
        purge_candidates(catalog, -1, AS_OF)
    for dry, confirm in ((True, True), (False, False)):
        with pytest.raises(ValueError):
            purge(spark, catalog, 90, AS_OF, dry_run=dry, confirm=confirm)


def test_paths_try_the_stored_form_first(spark):
    catalog = entries(spark, entry("base", 1, "x.csv"), entry("full", 0, "/tmp/x.csv"), entry("other", 0, "/data/y.csv"))
    paths = spark.createDataFrame([("/tmp/x.csv",), ("/data/y.csv",), ("/none",)], "path string")
    assert {r.path: r.id for r in by_paths(paths, catalog).collect()} == {"/tmp/x.csv": "base", "/data/y.csv": "other"}


def test_resolution_prefers_base(spark, bars):
    held = bars([("AAAA3", "2023-01-02", 1.0), ("AAAA3.SA", "2023-01-02", 1.0), ("BBBB3.SA", "2023-01-02", 1.0)])
    asked = spark.createDataFrame([("aaaa3",), ("BBBB3",), ("CCCC3",)], "requested string")
    assert {r.requested: r.ticker for r in resolve_tickers(asked, held).collect()} == {"aaaa3": "AAAA3", "BBBB3": "BBBB3.SA", "CCCC3": None}


def snapshots(tmp_path: Path, *file_names: str) -> dict[str, str]:
    folder = tmp_path / "snapshots"
    folder.mkdir(exist_ok=True)
    found = {}
    for name in file_names:
        (folder / name).write_text(f"bytes of {name}")
        found[name] = hashlib.sha256(f"bytes of {name}".encode()).hexdigest()
    return found


def test_hashes_and_sidecars(spark, tmp_path):
    digests = snapshots(tmp_path, "a.csv", "b.csv", "c.csv")
    folder = tmp_path / "snapshots"
    (folder / "a.csv.checksum").write_text(digests["a.csv"].upper())
    (folder / "b.csv.checksum").write_text("0" * 64 + "  b.csv\n")
    hashes = file_hashes(spark, str(folder), "*.csv")
    assert {Path(r.path).name: r.sha256 for r in hashes.collect()} == digests
    status = verify_sidecars(hashes, sidecar_hashes(spark, str(folder))).collect()
    assert {Path(r.path).name: r.status for r in status} == {"a.csv": "ok", "b.csv": "mismatch", "c.csv": "no_sidecar"}


def test_manifests(spark, tmp_path):
    data = {"a": {"sha256": "1"}, "b": {"sha256": "2"}}
    for document in ({"generated_at": "now", "files": data}, data):
        frame = spark.createDataFrame([(json.dumps(document),)], "value string")
        assert rows(read_manifest(frame)) == [("a", "1"), ("b", "2")]
    many = spark.range(2500).selectExpr("concat('p', id) AS path", "sha2(string(id), 256) AS sha256")
    write_manifest(many, f"{tmp_path}/m", "now")
    assert rows(load_manifest(spark, f"{tmp_path}/m")) == rows(many)
    current = spark.createDataFrame([("a", "1"), ("b", "9"), ("n", "3")], "path string, sha256 string")
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("gone", "3")], "path string, sha256 string")
    assert {r.path: r.status for r in compare_manifests(before, current).collect()} == {"b": "changed", "gone": "missing", "n": "unexpected"}


def test_manifest_layouts(spark, tmp_path):
    """Indented documents, one document per line, several files; anything else raises."""
    data = {"a b": {"sha256": "1"}, "b": {"sha256": "2"}}
    folder = tmp_path / "manifests"
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps({"generated_at": "now", "files": data}, indent=2) + "\n")
    (folder / "two.json").write_text("\n" + json.dumps({"c": {"sha256": "3"}}, indent=4))
    (folder / "three.json").write_text("\n".join(json.dumps({"files": {k: {"sha256": k}}}) for k in "xyz") + "\n")
    (folder / "empty.json").write_text("")
    assert {r.path for r in load_manifest(spark, str(folder)).collect()} == {"a b", "b", "c", "x", "y", "z"}
    for text in ("[1, 2]", "no json", '{"rows": 3}', '{"files": 7}'):
        frame = spark.createDataFrame([(text,)], "value string")
        with pytest.raises(Exception, match="not a manifest"):
            read_manifest(frame).collect()


def test_streamed_hash_of_a_large_file(spark, tmp_path):
    folder = tmp_path / "large"
    folder.mkdir()
    data = bytes(range(256)) * (100_000)  # several chunks
    (folder / "big file+1.csv").write_bytes(data)
    row = file_hashes(spark, str(folder)).first()
    assert (row.sha256, row.size_bytes) == (hashlib.sha256(data).hexdigest(), len(data))


def test_archive_when_idle_and_again(spark, tmp_path):
    digests = snapshots(tmp_path, "ok.csv")
    catalog = entries(spark, entry("1", 100, f"{tmp_path}/snapshots/ok.csv", digests["ok.csv"]), entry("2", 100, f"{tmp_path}/lost.csv", "x"))
    archive_dir = f"{tmp_path}/archive"
    nothing, same = purge(spark, catalog.filter("id = '0'"), 90, AS_OF, dry_run=False, confirm=True, archive_dir=archive_dir)
    assert nothing.count() == 0 and same.count() == 0
    lost, after = purge(spark, catalog.filter("id = '2'"), 90, AS_OF, dry_run=False, confirm=True, archive_dir=archive_dir)
    assert [r.checksum_ok for r in lost.collect()] == [False] and [r.archived for r in after.collect()] == [False]
    status, _ = purge(spark, catalog, 90, AS_OF, dry_run=False, confirm=True, archive_dir=archive_dir)
    assert {r.id: r.checksum_ok for r in status.collect()} == {"1": True, "2": False}
    plan = spark.range(10_000).selectExpr("concat('/none/', id) AS path", f"concat('{tmp_path}/t/', id) AS target")
    assert copy_files(plan, 8).select(F.spark_partition_id()).distinct().count() == 8


def test_archive(spark, tmp_path):
    digests = snapshots(tmp_path, "ok.csv", "bad.csv", "none.csv")
    folder = tmp_path / "snapshots"
    catalog = entries(
        spark,
        entry("1", 100, f"{folder}/ok.csv", digests["ok.csv"]),
        entry("2", 100, f"{folder}/bad.csv", "wrong"),
        entry("3", 100, f"{folder}/none.csv", None),
        entry("4", 100, f"{folder}/lost.csv", "x"),
        entry("5", 1, f"{folder}/ok.csv", "x"),
    )
    status, after = purge(spark, catalog, 90, AS_OF, dry_run=False, confirm=True, archive_dir=f"{tmp_path}/archive")
    assert {r.id: r.checksum_ok for r in status.collect()} == {"1": True, "2": False, "3": None, "4": False}
    assert {r.id: r.archived for r in after.collect()} == {"1": True, "2": True, "3": True, "4": False, "5": False}
    assert tuple(archive_totals(status).first()) == (4, 1, 1, 1)
    assert (tmp_path / "archive/files/1_ok.csv").read_bytes() == (folder / "ok.csv").read_bytes()


def test_delete(spark, tmp_path):
    snapshots(tmp_path, "old.csv", "old.csv.checksum", "new.csv")
    folder = tmp_path / "snapshots"
    catalog = entries(spark, entry("1", 100, f"{folder}/old.csv"), entry("2", 1, f"{folder}/new.csv"), entry("3", 100, f"{folder}/lost.csv"))
    outcome, after = purge(spark, catalog, 90, AS_OF, dry_run=False, confirm=True, report=f"{tmp_path}/report")
    assert {r.id: r.deleted for r in outcome.collect()} == {"1": True, "3": True}
    assert [r.id for r in after.collect()] == ["2"]
    assert [p.name for p in folder.iterdir()] == ["new.csv"]


def test_repairs(spark):
    catalog = entries(spark, entry("1", 0, "/tmp/a.csv", "1"), entry("2", 0, "/tmp/b.csv", "1"), entry("3", 0, "/tmp/c.csv"), entry("4"))
    files = spark.createDataFrame([("/data/s/a.csv", "1"), ("/data/s/b.csv", "9")], "path string, sha256 string")
    plan = repair_plan(catalog, files, "/data/s")
    assert {r.id: r.action for r in plan.collect()} == {"1": "update_path", "2": "archive", "3": "archive"}
    after = {r.id: (r.snapshot_path, r.archived) for r in apply_repairs(catalog, plan, AS_OF).collect()}
    assert after["1"] == ("/data/s/a.csv", False) and after["2"][1] and after["4"] == ("/data/x.csv", False)


@pytest.mark.parametrize(
    ("case", "verdict"),
    [("good", "PASS"), ("other_checksum", "WARN"), ("no_metadata", "FAIL"), ("repeated_key", "FAIL"), ("null_key", "FAIL"),
     ("missing_column", "FAIL"), ("no_rows", "FAIL")],
)
def test_restore_verdicts(spark, bars, case, verdict):
    frame = bars([("AAAA3", "2023-01-02", 1.0), ("AAAA3", "2023-01-03", 2.0)]).withColumn("file", F.lit("f"))
    if case == "repeated_key":
        frame = frame.unionByName(frame)
    if case == "null_key":
        frame = frame.withColumn("ticker", F.when(F.col("close") > 1, F.col("ticker")))
    if case == "missing_column":
        frame = frame.drop("volume")
    if case == "no_rows":
        frame = frame.limit(0)
    count = frame.count()
    hashes = spark.createDataFrame([("f", "h")], "file string, sha256 string")
    meta = [] if case == "no_metadata" else [("f", "x" if case == "other_checksum" else "h", count)]
    metadata = spark.createDataFrame(meta, "file string, checksum string, expected_rows long")
    found = restore_checks(frame, metadata, hashes).first()
    assert found.overall == verdict and found.exit_code == ["PASS", "WARN", "FAIL"].index(verdict)


def test_log_pages(spark):
    at = "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, id) "
    log = spark.range(20).selectExpr(
        "concat('j', lpad(id, 2, '0')) job_id", "'PETR4' ticker", "if(id % 2 = 0, 'error', 'success') status",
        f"{at} started_at", f"{at} + interval 90 seconds finished_at", "id rows", "cast(null as string) error_message",
    )
    page = search_log(log, "PETR4", "error", since="2024-01-05", limit=3, offset=1).collect()
    assert [r.job_id for r in page] == ["j06", "j08", "j10"] and page[0].duration_ms == 90000
