from __future__ import annotations

import datetime as dt
import hashlib
import os
from pathlib import Path

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barwright.functions.fingerprints import group_fingerprint, row_checksum
from barwright.operators.diff import (
    cache_decisions,
    change_counts,
    classify,
    classify_in_range,
    diff,
    file_cache_decisions,
    last_per_key,
    merge,
    merge_insert_only,
    rows_to_refresh,
    ticker_fingerprints,
)
from barwright.operators.ingest import (
    canonical_rows,
    catalog_entries,
    ingest_csv_folder,
    ingest_snapshot,
    processed_entries,
    quarantined_file_rows,
    staged,
)
from barwright.schema import PRICES, Field, names
from barwright.sources.prices import read_price_csv, read_prices, read_snapshot, write_snapshot
from barwright.sources.table import YearTable
from barwright.streaming.ingest import arrivals, counted_files, file_stream, quarantined, start_ingest

AS_OF = dt.datetime(2024, 2, 1, 12)


def closes(df):
    return {(r.ticker, str(r.date)): r.close for r in df.collect()}


def test_diff_cases(bars):
    store = bars([("AAAA3", "2023-01-02", 1.0), ("AAAA3", "2023-01-03", 2.0), ("AAAA3", "2023-01-04", None)])
    feed = bars([("AAAA3", "2023-01-02", 1.0), ("AAAA3", "2023-01-03", 2.5), ("AAAA3", "2023-01-04", None), ("AAAA3", "2023-01-05", 3.0)])
    fresh = feed.withColumn("raw_checksum", F.lit("other")).withColumn("fetched_at", F.lit(AS_OF))
    found = {str(r.date): r.change_type for r in classify(fresh, store).collect()}
    assert found == {"2023-01-02": "unchanged", "2023-01-03": "changed", "2023-01-04": "unchanged", "2023-01-05": "new"}
    assert diff(feed, feed).count() == 0
    assert diff(feed, store.limit(0)).count() == 4
    assert tuple(change_counts(classify_in_range(feed, store)).first()) == ("AAAA3", 2, 2)
    assert classify_in_range(feed.limit(0), store).count() == 0


def test_last_row_per_key_wins(bars):
    feed = bars([("AAAA3", "2023-01-02", float(i)) for i in range(50)])
    feed = feed.withColumn("seq", F.col("close").cast("int"))
    assert closes(last_per_key(feed, sequence=("seq",))) == {("AAAA3", "2023-01-02"): 49.0}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    old=st.dictionaries(st.integers(1, 9), st.one_of(st.none(), st.floats(1, 9)), max_size=6),
    new=st.dictionaries(st.integers(1, 9), st.one_of(st.none(), st.floats(1, 9)), max_size=6),
)
def test_merge_laws(bars, old, new):
    store = bars([("AAAA3", f"2023-01-0{d}", c) for d, c in old.items()])
    feed = bars([("AAAA3", f"2023-01-0{d}", c) for d, c in new.items()])
    once = merge(store, feed)
    assert {int(k[1][-1]): v for k, v in closes(once).items()} == {**old, **new}
    assert rows(merge(once, feed)) == rows(once)
    assert {int(k[1][-1]): v for k, v in closes(merge_insert_only(store, feed)).items()} == {**new, **old}
    assert diff(feed, once).count() == 0


def test_row_checksum_text(bars):
    row = bars([("AAAA3", "2023-01-02", 28.5)]).select(row_checksum().alias("c")).first()
    number = "28.5000000000"
    text = f"AAAA3|2023-01-02|{number}|{number}|{number}|{number}|100|desk"
    assert row.c == hashlib.sha256(text.encode()).hexdigest()


def test_fingerprint_sees_values_not_order(bars):
    frame = bars([("AAAA3", f"2023-01-{d:02d}", float(d)) for d in range(1, 29)])
    first = ticker_fingerprints(frame).first().checksum
    assert ticker_fingerprints(frame.orderBy(F.desc("close")).repartition(7)).first().checksum == first
    assert ticker_fingerprints(frame.withColumn("fetched_at", F.lit(AS_OF))).first().checksum == first
    assert ticker_fingerprints(frame.withColumn("close", F.col("close") + 1)).first().checksum != first


def test_cache_rules(spark, bars):
    prints = ticker_fingerprints(bars([("AAAA3", "2023-01-02", 1.0), ("BBBB3", "2023-01-02", 2.0)]))
    known = prints.select(
        "ticker",
        F.when(F.col("ticker") == "AAAA3", F.col("checksum")).otherwise("other").alias("last_checksum"),
        F.lit(AS_OF - dt.timedelta(hours=1)).alias("generated_at"),
    )

    def decide(**options):
        return {r.ticker: r.decision for r in cache_decisions(prints, known, AS_OF, **options).collect()}

    assert decide() == {"AAAA3": "checksum_match", "BBBB3": "miss"}
    assert decide(ttl_seconds=7200) == {"AAAA3": "within_ttl", "BBBB3": "miss"}
    assert decide(ttl_seconds=60)["AAAA3"] == "miss"
    assert decide(force=True)["AAAA3"] == "miss"
    frame = bars([("AAAA3", "2023-01-02", 1.0), ("BBBB3", "2023-01-02", 2.0)])
    assert [r.ticker for r in rows_to_refresh(frame, cache_decisions(prints, known, AS_OF)).collect()] == ["BBBB3"]


def test_file_cache(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "path string, sha256 string")
    entries = [("a", "1", "2024-02-01T11:59:59+00:00"), ("b", "2", "2024-02-01T11:59:59"), ("c", "1", "garbage")]
    known = spark.createDataFrame(entries, "path string, sha256 string, processed_at string")

    def cached(**options):
        return {r.path for r in file_cache_decisions(files, known, AS_OF, **options).filter("cached").collect()}

    assert cached() == {"a", "c"} and cached(ttl_seconds=60) == {"a"} and cached(ttl_seconds=0.5) == set()


def test_table_versions(spark, bars, tmp_path):
    table = YearTable(spark, f"{tmp_path}/prices")
    assert table.version() == 0 and table.read().count() == 0
    table.upsert(bars([("AAAA3", "2021-06-01", 1.0), ("AAAA3", "2022-06-01", 2.0), ("BBBB3", "2022-06-01", 5.0)]))
    table.upsert(bars([("AAAA3", "2022-06-01", 3.0), ("AAAA3", "2023-06-01", 4.0)]))
    assert table.version() == 2
    assert closes(table.read("AAAA3")) == {("AAAA3", "2021-06-01"): 1.0, ("AAAA3", "2022-06-01"): 3.0, ("AAAA3", "2023-06-01"): 4.0}
    assert closes(table.read("aaaa3.sa", "2022-01-01", "2022-12-31")) == {("AAAA3", "2022-06-01"): 3.0}
    assert closes(table.read(version=1))[("AAAA3", "2022-06-01")] == 2.0
    untouched = table.versions().filter("year = 2021").select("path").distinct()
    assert untouched.count() == 1  # carried over by reference
    with pytest.raises(ValueError, match="not unique"):
        table.upsert(bars([("AAAA3", "2021-06-01", 1.0), ("AAAA3", "2021-06-01", 2.0)]))
    assert table.version() == 2
    Path(f"{tmp_path}/prices/versions/v=3").mkdir()  # a writer that died before it published
    assert table.upsert(bars([("AAAA3", "2021-06-01", 9.0)])) == 4
    assert closes(table.read("AAAA3"))[("AAAA3", "2021-06-01")] == 9.0


def test_inclusive_range(bars):
    frame = bars([("AAAA3", f"2023-01-0{d}", 1.0) for d in range(1, 8)])
    assert read_prices(frame, "AAAA3", "2023-01-03", "2023-01-05").count() == 3
    with pytest.raises(ValueError):
        read_prices(frame, columns=["close; drop"])


def test_snapshot_files_round_trip(spark, bars, tmp_path):
    frame = bars([("AAAA3", f"2023-01-0{d}", None if d == 3 else d / 3) for d in range(1, 8)] + [("BBBB3", "2023-01-01", 2.0)])
    write_snapshot(frame, f"{tmp_path}/s", rows_per_file=2)
    assert rows(read_snapshot(spark, f"{tmp_path}/s")) == rows(frame)
    assert len(list(Path(f"{tmp_path}/s/_ticker=AAAA3").glob("*.csv"))) >= 4


def test_snapshot_ingest_uses_the_cache(spark, bars, tmp_path):
    table = YearTable(spark, f"{tmp_path}/prices")
    feed = bars([("AAAA3", "2023-01-02", 1.0), ("BBBB3", "2023-01-02", 2.0)])
    empty = spark.createDataFrame([], "id string, ticker string, created_at timestamp, checksum string, snapshot_path string")
    first = ingest_snapshot(spark, feed, table, empty, f"{tmp_path}/one", AS_OF)
    catalog = catalog_entries(first.report, f"{tmp_path}/one", AS_OF)
    assert catalog.count() == 2 and table.version() == 1
    changed = feed.withColumn("close", F.when(F.col("ticker") == "BBBB3", 3.0).otherwise(F.col("close")))
    second = ingest_snapshot(spark, changed, table, catalog, f"{tmp_path}/two", AS_OF)
    found = {r.ticker: (r.decision, r.processed_rows) for r in second.report.collect()}
    assert found == {"AAAA3": ("checksum_match", 0), "BBBB3": ("miss", 1)}
    assert closes(table.read())[("BBBB3", "2023-01-02")] == 3.0


HEADER = "ticker,date,open,high,low,close,volume,source,fetched_at,raw_checksum\n"


def write_csv(folder: Path, name: str, lines: list[str], sidecar: str | None = "right"):
    folder.mkdir(exist_ok=True)
    data = (HEADER + "\n".join(lines) + "\n").encode()
    (folder / name).write_bytes(data)
    if sidecar:
        digest = hashlib.sha256(data if sidecar == "right" else b"other").hexdigest()
        (folder / f"{name}.checksum").write_text(f"{digest}  {name}\n")


def line(ticker, day, close):
    return f"{ticker},{day},1,2,1,{close},100,desk,,"


def test_csv_folder_ingest(spark, tmp_path):
    inbox = tmp_path / "inbox"
    write_csv(inbox, "a.csv", [line("AAAA3.SA", "2023-01-02", 1.5), line("AAAA3.SA", "2023-01-03", 1.6)])
    write_csv(inbox, "b.csv", [line("BBBB3", "2023-01-02", 2.5)], sidecar="wrong")
    write_csv(inbox, "c.csv", [line("CCCC3", "2023-01-02", 1), line("DDDD3", "2023-01-02", 1)])
    write_csv(inbox, "d.csv", [line("EEEE3", "2023-01-02", 3.5), line("EEEE3", "not a date", 1)], sidecar=None)
    table = YearTable(spark, f"{tmp_path}/prices")
    nothing = spark.createDataFrame([], "path string, sha256 string, processed_at string")
    result = ingest_csv_folder(spark, str(inbox), table, nothing, f"{tmp_path}/w1", AS_OF)
    found = {r.path.rsplit("/", 1)[1]: r.decision for r in result.report.collect()}
    assert found == {"a.csv": "ingest", "b.csv": "bad_checksum", "c.csv": "several_tickers", "d.csv": "ingest"}
    assert closes(table.read()) == {("AAAA3", "2023-01-02"): 1.5, ("AAAA3", "2023-01-03"): 1.6, ("EEEE3", "2023-01-02"): 3.5}
    again = ingest_csv_folder(spark, str(inbox), table, processed_entries(result.report, AS_OF), f"{tmp_path}/w2", AS_OF)
    assert {r.decision for r in again.report.collect()} == {"cached", "bad_checksum", "several_tickers"}
    assert again.version == result.version


def test_stream_ingest(spark, tmp_path):
    inbox = tmp_path / "inbox"
    table = YearTable(spark, f"{tmp_path}/prices")

    def run():
        start_ingest(spark, str(inbox), table, f"{tmp_path}/check", f"{tmp_path}/bad", AS_OF, files_per_batch=1).awaitTermination()

    write_csv(inbox, "a.csv", [line("AAAA3", "2023-01-02", 1.5), line("AAAA3", "oops", 1)], sidecar=None)
    write_csv(inbox, "b.csv", [line("AAAA3", "2023-01-03", 2.5)], sidecar=None)
    run()
    assert closes(table.read()) == {("AAAA3", "2023-01-02"): 1.5, ("AAAA3", "2023-01-03"): 2.5}
    version = table.version()
    run()
    assert table.version() == version  # nothing new, nothing published
    write_csv(inbox, "c.csv", [line("AAAA3", "2023-01-02", 9.5)], sidecar=None)  # a late correction
    run()
    assert closes(table.read())[("AAAA3", "2023-01-02")] == 9.5
    assert [r.date for r in quarantined(spark, f"{tmp_path}/bad").collect()] == [None]
    assert {r.batch_id for r in table.versions().filter("source IS NOT NULL").collect()} == {0, 1, 2}
    counted = {r.path.rsplit("/", 1)[1]: (r.rows, r.processed_rows, r.invalid_rows) for r in counted_files(spark, f"{tmp_path}/bad").collect()}
    assert counted == {"a.csv": (2, 1, 1), "b.csv": (1, 1, 0), "c.csv": (1, 1, 0)}


def test_two_streams_and_a_plain_upsert(spark, bars, tmp_path):
    """Batches are known per stream: neither another stream, nor a new checkpoint, nor an upsert hides or repeats one."""
    table = YearTable(spark, f"{tmp_path}/prices")

    def run(inbox, checkpoint):
        start_ingest(spark, str(inbox), table, f"{tmp_path}/{checkpoint}", f"{tmp_path}/work", AS_OF).awaitTermination()

    write_csv(tmp_path / "one", "a.csv", [line("AAAA3", "2023-01-02", 1.5)], sidecar=None)
    write_csv(tmp_path / "two", "b.csv", [line("BBBB3", "2023-01-02", 2.5)], sidecar=None)
    run(tmp_path / "one", "c1")
    run(tmp_path / "two", "c2")
    assert closes(table.read()) == {("AAAA3", "2023-01-02"): 1.5, ("BBBB3", "2023-01-02"): 2.5}
    table.upsert(bars([("AAAA3", "2023-01-02", 7.5)]))
    marks = {r.source for r in table.versions().filter(f"version = {table.version()} AND source IS NOT NULL").collect()}
    assert len(marks) == 2 and {table.last_batch(m) for m in marks} == {0}  # a batch given again would be skipped
    run(tmp_path / "one", "c1")
    assert closes(table.read())[("AAAA3", "2023-01-02")] == 7.5
    run(tmp_path / "one", "renewed")
    assert closes(table.read())[("AAAA3", "2023-01-02")] == 1.5


def test_file_ingest_loses_nothing(spark, tmp_path):
    inbox, table = tmp_path / "in box", YearTable(spark, f"{tmp_path}/prices")
    names_ = ["my file.csv", "a+b.csv", "100%25.csv"]
    for n, name in enumerate(names_):
        write_csv(inbox, name, [line(f"AAA{n}3", "2023-01-02", 1.5), line(f"AAA{n}3", "oops", 1), f"AAA{n}3,2023-01-02,1", line(f"AAA{n}3.SA", "2023-01-03", 2)])
    (inbox / "z.csv").write_text(HEADER + line("AAA03", "2023-01-02", 0.5) + "\n" + line("AAA03", "2023-01-03", 2) + "\n")  # later and lower
    os.utime(inbox / "z.csv", (2e9, 2e9))
    nothing = spark.createDataFrame([], "path string, sha256 string, processed_at string")
    result = ingest_csv_folder(spark, str(inbox), table, nothing, f"{tmp_path}/w1", AS_OF)
    found = {r.path.rsplit("/", 1)[1]: r for r in result.report.collect()}
    assert {n: r.decision for n, r in found.items()} == dict.fromkeys([*names_, "z.csv"], "ingest")
    for r in found.values():
        assert r.rows == r.processed_rows + r.skipped_rows + r.superseded_rows + r.invalid_rows
    assert (found["my file.csv"].rows, found["my file.csv"].invalid_rows, found["my file.csv"].superseded_rows) == (4, 2, 2)
    bad = quarantined_file_rows(spark, f"{tmp_path}/w1").select("_corrupt", "errors").collect()
    assert len(bad) == 6 and sum(any(e.reason_code == "MALFORMED_LINE" for e in r.errors) for r in bad) == 3
    assert closes(table.read("AAA03")) == {("AAA03", "2023-01-02"): 0.5, ("AAA03", "2023-01-03"): 2.0}
    write_csv(inbox, "my file.csv", [line("AAA03", "2023-01-05", 9)], sidecar="wrong")
    again = ingest_csv_folder(spark, str(inbox), table, nothing, f"{tmp_path}/w2", AS_OF)
    assert {r.path.rsplit("/", 1)[1]: r.decision for r in again.report.collect()}["my file.csv"] == "bad_checksum"


def test_upsert_keeps_the_stored_form_and_refuses_null_dates(spark, bars, tmp_path):
    table = YearTable(spark, f"{tmp_path}/prices")
    table.upsert(bars([(" aaaa3.sa ", "2021-06-01", 1.0)]))
    assert closes(table.read("AAAA3")) == {("AAAA3", "2021-06-01"): 1.0}
    assert closes(table.read("AAAA3.SA")) == closes(table.read("aaaa3"))
    with pytest.raises(ValueError, match="null"):
        table.upsert(bars([("AAAA3", None, 1.0)]))
    assert table.version() == 1


def test_upsert_rewrites_only_what_it_touches(spark, bars, tmp_path):
    table = YearTable(spark, f"{tmp_path}/prices")
    table.upsert(bars([(f"AA{i:02d}3", f"202{y}-06-01", 1.0) for i in range(40) for y in (1, 2)]))
    before = {r.path for r in table.versions().collect()}
    table.upsert(bars([("AA003", "2021-06-01", 2.0)]))
    now = {r.path for r in table.versions().filter("version = 2").collect()}
    assert len(now - before) == 1 and len(now) == len(before)
    listed = table.read("AA003", "2021-01-01", "2021-12-31").inputFiles()
    assert len({f.rsplit("/", 1)[0] for f in listed}) == 1


def test_repeated_write_replaces_all_partitions(spark, tmp_path):
    first = spark.createDataFrame([("a", 1), ("b", 2)], "v string, k int")
    staged(spark, first, f"{tmp_path}/s", "overwrite", ("k",))
    assert rows(staged(spark, first.filter("k = 1"), f"{tmp_path}/s", "overwrite", ("k",))) == [("a", 1)]


def test_checksums_of_huge_numbers_and_sums(spark, bars):
    a, b, c = (ticker_fingerprints(bars([("AAAA3", "2023-01-02", v)])).first().checksum for v in (1e18, 2e18, 1e40))
    assert len({a, b, c}) == 3
    digest = "f" * 64
    big = spark.range(1).select(F.sum(F.lit("9" * 25).cast("decimal(28,0)")).alias("s")).schema["s"].dataType
    assert big.precision == 38
    assert spark.range(10).select(group_fingerprint(F.lit(digest)).alias("c")).first().c



def test_arrivals_counts_a_running_stream(spark, tmp_path):
    write_csv(tmp_path / "in", "a.csv", [line("AAAA3", "2023-01-02", 1.5), line("AAAA3", "2023-01-03", 1)], sidecar=None)
    counts = arrivals(file_stream(spark, f"{tmp_path}/in"))
    run = counts.writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert rows(spark.table("seen")) == [("AAAA3", 2)]


def test_canonical_rows_fill_metadata(spark):
    frame = spark.createDataFrame([(" petr4.sa", "2023-01-02", "1", "2", "1", "1.5", "100.0"), ("", "2023-01-02", "1", "2", "1", "1", "1")],
                                  "ticker string, date string, open string, high string, low string, close string, volume string")
    found = canonical_rows(frame, AS_OF).collect()
    assert len(found) == 1 and found[0].ticker == "PETR4" and found[0].source == "snapshot"
    assert list(found[0].asDict()) == names(PRICES) and len(found[0].raw_checksum) == 64


def test_csv_columns_follow_the_header(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("close,date,ticker,volume\n1.5,2023-01-02,AAAA3,7\n")
    found = read_price_csv(spark, str(folder), typed=True).first()
    assert (found.ticker, str(found.date), found.close, found.volume, found.open) == ("AAAA3", "2023-01-02", 1.5, 7, None)
    (folder / "b.csv").write_text("ticker,date,close,volume\nAAAA3,2023-01-03,1.5,7\n")
    (folder / "c.csv").write_text("nothing,to,see\n1,2,3\n")
    (folder / "d.csv").write_bytes(b"\xff\xfe\x00ticker,date\n")
    (folder / "e.csv").write_bytes(b"")
    raw = read_price_csv(spark, str(folder))
    read = {r.file.rsplit("/", 1)[1]: (r.ticker, r.date, r.close, r.volume, r._corrupt) for r in raw.collect()}
    assert read == {
        "a.csv": ("AAAA3", "2023-01-02", "1.5", "7", None), "b.csv": ("AAAA3", "2023-01-03", "1.5", "7", None),
        "c.csv": (None, None, None, None, "header lacks ticker, date"), "d.csv": (None, None, None, None, "header is no text"),
    }


def test_migration_counts_before_it_publishes(spark, bars, tmp_path):
    table = YearTable(spark, f"{tmp_path}/prices")
    table.upsert(bars([("AAAA3", "2021-06-01", 1.0), ("AAAA3", "2022-06-01", 2.0)]), source="feed", batch_id=4)
    wanted = tuple(Field("last", f.kind, f.nullable) if f.name == "close" else f for f in PRICES)
    with pytest.raises(ValueError, match="2021/.*1 -> None"):
        table.migrate(wanted, lambda df: df.withColumnRenamed("close", "last").filter("last > 1"))
    with pytest.raises(ValueError, match="1 -> 2"):
        table.migrate(wanted, lambda df: df.withColumnRenamed("close", "last").unionByName(df.withColumnRenamed("close", "last")))
    with pytest.raises(ValueError, match="keys"):
        table.migrate(wanted[1:], lambda df: df)
    assert table.version() == 1 and closes(table.read()) == {("AAAA3", "2021-06-01"): 1.0, ("AAAA3", "2022-06-01"): 2.0}
    version = table.migrate(wanted, lambda df: df.withColumnRenamed("close", "last"))
    assert table.version() == version and table.last_batch("feed") == 4
    assert table.read().columns == [f.name for f in wanted] == [f.name for f in table.columns()]
    assert "close" in table.read(version=1).columns
    table.upsert(bars([("AAAA3", "2021-06-01", 9.0)]).withColumnRenamed("close", "last"))  # by the new columns
    again = YearTable(spark, f"{tmp_path}/prices")
    assert {(str(r.date), r.last) for r in again.read().collect()} == {("2021-06-01", 9.0), ("2022-06-01", 2.0)}


def test_first_rows_are_written_once_and_kept_rows_join_their_unit(spark, bars, tmp_path):
    table = YearTable(spark, f"{tmp_path}/prices", buckets=1)
    table.upsert(bars([("AAAA3", "2021-06-01", 1.0), ("BBBB3", "2021-06-01", 2.0)]))
    assert not Path(f"{tmp_path}/prices/staging").exists()  # the units are the only copy
    table.upsert(bars([("BBBB3", "2021-06-01", 3.0), ("CCCC3", "2021-06-01", 4.0)]))
    assert closes(table.read()) == {("AAAA3", "2021-06-01"): 1.0, ("BBBB3", "2021-06-01"): 3.0, ("CCCC3", "2021-06-01"): 4.0}
    assert len(table.unit_paths()) == 1 and closes(table.read(version=1))[("BBBB3", "2021-06-01")] == 2.0


def test_texts_come_back_from_a_shuffle_as_they_were(spark):
    from barwright.sources.table import _packed, _unpacked

    digest = "0123456789abcdef" * 4
    texts = [digest, digest.upper(), digest[:-1] + "x", digest[:-2], "", "\x01" + digest, "é" * 32, None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", _packed(F.col("t")).alias("p"))
    found = frame.select("t", _unpacked(F.col("p")).alias("u"), F.octet_length("p").alias("n")).collect()
    assert [r.u for r in found] == texts and found[0].n == 33


def test_word_sums_add_plain_longs(spark):
    from barwright.functions.fingerprints import WORDS, word_sums

    digests = ["ffffffff" * WORDS, "0001ffff" * WORDS, "00000001" * WORDS]
    sums = spark.createDataFrame([(d,) for d in digests], "d string").groupBy().agg(*word_sums(F.col("d")))
    assert {f.dataType.simpleString() for f in sums.schema} == {"decimal(38,0)"}
    assert [int(v) for v in sums.first()] == [0xFFFFFFFF + 0x1FFFF + 1] * WORDS
    assert "sum(cast(conv" not in sums._jdf.queryExecution().optimizedPlan().toString().lower()


def test_units_that_only_get_new_keys_are_not_written_again(spark, bars, tmp_path, monkeypatch):
    from barwright.operators.ingest import apply_changes
    from barwright.operators.prints import TablePrints
    from barwright.sources import table as module

    monkeypatch.setattr(module, "LAYERS", 3)
    table = YearTable(spark, f"{tmp_path}/t", buckets=1)
    days = ["2021-06-01", "2021-06-02", "2021-06-03", "2021-06-04", "2021-06-05"]
    written = []
    for n, day in enumerate(days):
        apply_changes(table, bars([("AAAA3", day, 1.0 + n), ("AAAA3", f"2022-06-0{n + 1}", 1.0)]), f"{tmp_path}/w{n}")
        paths = table.unit_paths()
        assert len(paths) == len(set(paths)) and table.read().count() == 2 * (n + 1)
        written.append(len([p for p in paths if "_year=2021" in p]))
    assert written == [1, 2, 3, 1, 2]  # the third folder is the last one before the unit is written anew
    apply_changes(table, bars([("AAAA3", days[0], 9.0), ("AAAA3", "2022-06-09", 3.0)]), f"{tmp_path}/changed")
    paths = table.unit_paths()
    assert [len([p for p in paths if f"_year={y}" in p]) for y in (2021, 2022)] == [1, 3]
    assert sorted(r.close for r in table.read(end="2021-12-31").collect()) == [2.0, 3.0, 4.0, 5.0, 9.0]
    assert table.read(version=2).count() == 4
    found = TablePrints(spark, table).fingerprints().collect()
    assert rows(spark.createDataFrame(found).select("ticker", "checksum", "rows")) == rows(ticker_fingerprints(table.read()).select("ticker", "checksum", "rows"))
