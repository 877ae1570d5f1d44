"""Properties of plans that matter on large data."""

from __future__ import annotations

import contextlib
import io
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barwright.operators import correlation
from barwright.operators.catalog import prune_list
from barwright.operators.diff import ticker_fingerprints
from barwright.operators.prints import TablePrints
from barwright.operators.returns import return_series, simple_returns
from barwright.plans.queries_series import daily_returns
from barwright.sources.prices import read_prices
from barwright.sources.table import YearTable

SF_DIR = "/root/testdata/sf0.001"
# Queries that write files first; their plans are those of the files read back.
WRITING = re.compile("ingest|round_trip|table_after|checked|quarantin|export|typed_csv|archive|deleted|sidecar|file_line|event_log|snapshot_catalog|mixed|processed|documents|restores|pruned|audit|migrated|table_|added_years|correlation|covariance|portfolio|^op|^pipeline")


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")
def test_no_query_crosses_its_inputs(spark):
    for name, query in entry.queries().items():
        if not WRITING.search(name):
            text = plan(query(spark, SF_DIR))
            assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name
            assert "BatchEvalPython" not in text and "MapInPandas" not in text, name


def test_filters_and_columns_reach_the_scan(spark, bars, tmp_path):
    table = YearTable(spark, f"{tmp_path}/prices")
    table.upsert(bars([("AAAA3", "2021-06-01", 1.0), ("AAAA3", "2022-06-01", 2.0)]))
    text = plan(read_prices(table.read(), "AAAA3", "2022-01-01", columns=["date", "close"]))
    pushed = re.search(r"PushedFilters: (.*)", text).group(1)
    assert "GreaterThanOrEqual(date" in pushed and "In(ticker" in pushed
    assert re.search(r"ReadSchema: struct<ticker:string,date:date,close:double>", text)
    assert "_year=2021" not in plan(table.read(start="2022-01-01"))  # other years are not even listed


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")
def test_series_share_one_shuffle_and_never_sort_whole_tickers(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # reuse shows in the static plan
    try:
        text = plan(daily_returns(spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("Scan parquet") == 2 and "ReusedExchange" in text  # one scan in the tree and in the details


def test_rows_are_windowed_by_year(bars):
    text = plan(simple_returns(bars([("AAAA3", "2021-06-01", 1.0)])))
    for window in re.findall(r"windowspecdefinition\(([^)]*)", text):
        assert "_segment" in window


def test_newest_files_are_limited_before_the_shuffle(spark):
    files = spark.createDataFrame([("PETR4-20230101T000000.csv",)], "name string")
    text = plan(prune_list(files, 2))
    assert re.search(r"WindowGroupLimit", text) and "Partial" in text


def test_rows_of_series_are_shuffled_once_for_all_returns(spark, bars):
    """Returns and what they add up to: one shuffle of rows and small ones of a row a year; no window spans a ticker's history."""
    prices = bars([("AAAA3", "2021-06-01", 1.0), ("AAAA3", "2022-06-01", 2.0)])
    text = plan(return_series(prices))
    for window in re.findall(r"windowspecdefinition\(([^)]*)", text):
        assert "_segment" in window
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tree = plan(return_series(prices)).split("\n\n")[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"(?<!Reused)Exchange", tree)) <= 4  # rows, totals, and the carried table there and back


def test_pairs_of_blocks_are_dealt_once(spark):
    """A packed row is copied once a block, to the upper triangle of the block grid only."""
    packed = spark.createDataFrame([(f"T{i}", 2020) for i in range(40)], "ticker string, year int")
    dealt = correlation._in_blocks(packed, F.lit(5)).collect()
    assert len(dealt) == 40 * 5 and all(r.low <= r.high and r.block in (r.low, r.high) for r in dealt)
    assert {(r.low, r.high) for r in dealt} == {(a, b) for a in range(5) for b in range(a, 5)}


def test_one_changed_bar_hashes_one_unit(spark, bars, tmp_path):
    table = YearTable(spark, f"{tmp_path}/prices")
    table.upsert(bars([(f"AA{i:02d}3", f"202{y}-06-01", 1.0) for i in range(40) for y in (1, 2)]))
    prints = TablePrints(spark, table)
    assert len(prints.missing()) == len(table.unit_paths())
    prints.update()
    assert prints.missing() == [] and prints.new_rows().inputFiles() == []
    table.upsert(bars([("AA003", "2021-06-01", 2.0)]))
    read = {f.rsplit("/", 1)[0] for f in prints.new_rows().inputFiles()}
    assert len(read) == 1 and "_year=2021" in read.pop()
    full = ticker_fingerprints(table.read())
    assert sorted(map(tuple, prints.fingerprints().select("ticker", "checksum", "rows").collect())) == sorted(map(tuple, full.collect()))
    old = ticker_fingerprints(table.read(version=1))
    assert sorted(map(tuple, prints.fingerprints(1).select("ticker", "checksum", "rows").collect())) == sorted(map(tuple, old.collect()))
