from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from barwright.operators import correlation
from barwright.operators.correlation import (
    correlation_matrix,
    correlation_wide,
    merged_sums,
    origins,
    pair_statistics,
    pair_sums,
    statistics_of,
)
from barwright.operators.portfolio import equal_weight_portfolio, equal_weights, summed_by_dates, total_covariance
from barwright.operators.returns import (
    compute_returns,
    cumulative_returns,
    last_before,
    log_returns,
    return_series,
    simple_returns,
)
from barwright.operators.stats import annualized, period_statistics

CREATED = dt.datetime(2024, 2, 1)


def series(ticker, closes, first=dt.date(2019, 12, 20), step=5):
    """Closes spread so that the series crosses calendar years."""
    return [(ticker, str(first + dt.timedelta(days=step * i)), c) for i, c in enumerate(closes)]


@pytest.mark.parametrize(
    "closes",
    [
        [10.0, 11.0, 12.5, 12.5, 9.0],
        [10.0, None, 12.0, None, None, 15.0],
        [None, None, 5.0, 6.0],
        [7.0],
        [3.0, float("nan"), 4.0],
        [1.0 + i % 7 for i in range(300)],
        [None if i % 3 else 1.0 + i for i in range(200)],
    ],
)
def test_simple_returns_equal_pandas(spark, bars, closes):
    data = series("ABCD3", closes)
    found = simple_returns(bars(data)).orderBy("date").toPandas()
    frame = pd.Series(closes, index=[d for _, d, *_ in data], dtype=float)
    expected = frame.ffill().pct_change(fill_method=None).dropna()
    assert [str(d) for d in found["date"]] == list(expected.index)
    np.testing.assert_allclose(found["return_value"].to_numpy(dtype=float), expected.to_numpy(), atol=1e-9)


def test_zero_price(bars):
    prices = bars(series("ABCD3", [10.0, None, 12.0, 0.0, 0.0, 3.0]))
    dropped = [r.return_value for r in simple_returns(prices).orderBy("date").collect()]
    assert dropped == pytest.approx([0.0, 0.2, -1.0])
    kept = [r.return_value for r in simple_returns(prices, keep_infinite=True).orderBy("date").collect()]
    assert kept[:3] == pytest.approx([0.0, 0.2, -1.0]) and kept[3] == math.inf and len(kept) == 4


def test_gap_longer_than_a_year_carries_on(bars):
    prices = bars([("ABCD3", "2015-06-01", 10.0), ("ABCD3", "2017-01-02", None), ("ABCD3", "2021-03-01", 15.0)])
    assert [r.return_value for r in simple_returns(prices).orderBy("date").collect()] == pytest.approx([0.0, 0.5])
    logs = [r.log_return for r in log_returns(prices).orderBy("date").collect()]
    assert logs == [None, None, None]  # a plain shift does not fill


def test_n_minus_one_returns_and_range(bars):
    prices = bars(series("ABCD3", [10.0, 11.0, 12.0, 13.0], dt.date(2023, 1, 2), 1))
    assert simple_returns(prices).count() == 3
    ranged = compute_returns(prices, CREATED, ["abcd3"], "2023-01-03", "2023-01-04")
    assert [str(r.date) for r in ranged.collect()] == ["2023-01-04"]
    back = compute_returns(prices, CREATED, start="2023-01-03", end="2023-01-04", lookback=last_before(prices, "2023-01-03"))
    assert sorted(str(r.date) for r in back.collect()) == ["2023-01-03", "2023-01-04"]


def test_single_row_and_empty_give_nothing(bars):
    one = bars([("SING3", "2023-01-02", 5.0)])
    assert simple_returns(one).count() == 0
    assert compute_returns(one.limit(0), CREATED).count() == 0


def test_returns_rerun_keeps_created_at(bars):
    prices = bars(series("ABCD3.SA", [10.0, 11.0, 12.0]))
    first = compute_returns(prices, CREATED)
    again = compute_returns(prices, dt.datetime(2025, 1, 1), stored=first)
    assert rows(again) == rows(first)
    assert {r.ticker for r in again.collect()} == {"ABCD3"}


def test_cumulative_return_survives_total_loss(bars):
    prices = bars(series("ABCD3", [10.0, 12.0, 6.0, 9.0], step=200))
    found = cumulative_returns(simple_returns(prices)).orderBy("date").collect()
    assert [r.cumulative_return for r in found] == pytest.approx([0.2, -0.4, -0.1])
    lost = cumulative_returns(simple_returns(bars(series("ABCD3", [10.0, 0.0], step=200)))).first()
    assert lost.cumulative_return == -1.0


def test_statistics_equal_numpy(bars):
    closes = [10.0, 10.5, 9.8, 11.0, 12.0]
    row = annualized(period_statistics(bars(series("ABCD3", closes)))).first()
    r = np.diff(np.log(closes))
    assert row.period_return == pytest.approx(r.sum())
    assert row.mean_return == pytest.approx(r.mean())
    assert row.risk == pytest.approx(r.std(ddof=1))
    assert row.annual_return == pytest.approx((1 + r.mean()) ** 252 - 1)
    assert row.annual_risk == pytest.approx(r.std(ddof=1) * math.sqrt(252))
    assert row.variation == pytest.approx(r.std(ddof=1) / r.mean())
    flat = annualized(period_statistics(bars(series("FLAT3", [5.0, 5.0, 5.0])))).first()
    assert flat.variation is None and flat.risk == 0


def returns_frame(spark, seed=7, tickers=9, days=500):
    rng = np.random.default_rng(seed)
    first = dt.date(2019, 9, 1)
    data = [
        (f"T{t:04d}", first + dt.timedelta(days=int(d)), float(rng.normal() * 0.02 + 0.001 * t))
        for t in range(tickers)
        for d in range(days)
        if rng.random() < 0.6
    ]
    data += [("FLAT1", first + dt.timedelta(days=d), 0.1) for d in range(days)]
    data += [("LATE1", first + dt.timedelta(days=days + 40), 0.2)]
    return spark.createDataFrame(data, "ticker string, date date, return_value double")


@pytest.mark.parametrize("block", [2, 64])
def test_correlation_equals_pandas(spark, block):
    returns = returns_frame(spark)
    wide = returns.toPandas().pivot(index="date", columns="ticker", values="return_value").astype(float)
    expected = wide.corr()
    expected.loc["FLAT1"] = np.nan
    expected["FLAT1"] = np.nan
    found = {(r.ticker_a, r.ticker_b): r.correlation for r in correlation_matrix(returns, block=block).collect()}
    assert len(found) == 101  # every pair of the first ten in both orders, and the late one with itself
    for (a, b), value in found.items():
        if np.isnan(expected.loc[a, b]):
            assert value is None, (a, b, value)
        else:
            assert value == pytest.approx(expected.loc[a, b], abs=1e-9)


def test_covariance_and_wide_form(spark):
    returns = returns_frame(spark, tickers=3)
    wide = returns.toPandas().pivot(index="date", columns="ticker", values="return_value").astype(float)
    for r in pair_statistics(returns, block=2).collect():
        if r.days > 1:
            assert r.covariance == pytest.approx(wide.cov().loc[r.ticker_a, r.ticker_b], abs=1e-12)
    table = correlation_wide(returns, ["T0000", "T0001"])
    assert table.columns == ["ticker_a", "T0000", "T0001"] and table.count() == 2


def test_portfolio_is_deterministic(spark):
    returns = returns_frame(spark, tickers=4).filter("ticker like 'T%'")
    as_of = dt.date(2021, 6, 1)
    a = equal_weight_portfolio(returns, as_of).first()
    b = equal_weight_portfolio(returns.repartition(7), as_of).first()
    other = equal_weight_portfolio(returns, as_of, lookback_days=400).first()
    assert a.run_id == b.run_id != other.run_id
    wide = returns.toPandas().pivot(index="date", columns="ticker", values="return_value").astype(float)
    assert a.volatility == pytest.approx(math.sqrt(wide.cov().to_numpy().mean() * 252))
    assert a.sharpe == pytest.approx(a.expected_return / a.volatility)
    assert equal_weights(returns).agg(F.sum("weight")).first()[0] == pytest.approx(1.0)


@pytest.mark.parametrize(
    "closes",
    [
        [10.0, 11.0, 12.5, 12.5, 9.0],
        [None, 10.0, None, 12.0, None, None, 15.0],
        [0.0, 0.0, 5.0, 6.0, 0.0, None, 7.0, 8.0],
        [5.0, 0.0, 3.0],
        [None, None],
        [3.0, float("nan"), 4.0],
        [1.0 + i % 7 for i in range(300)],
        [None if i % 3 else 1.0 + i % 11 for i in range(200)],
        [None if i % 40 else 2.0 + i % 13 for i in range(400)],
    ],
)
def test_one_pass_equals_the_single_operators(bars, closes):
    """Fill, lag and running product from one carried table, over years with and without values."""
    prices = bars(series("ABCD3", closes) + series("EFGH3", closes[::-1]))
    found = {(r.ticker, r.date): r for r in return_series(prices).collect()}
    assert len(found) == 2 * len(closes)
    simple = {(r.ticker, r.date): r.return_value for r in simple_returns(prices).collect()}
    assert {k: r.return_value for k, r in found.items() if r.return_value is not None} == pytest.approx(simple)
    logs = {(r.ticker, r.date): r.log_return for r in log_returns(prices).collect()}
    for key, value in logs.items():
        assert found[key].log_return == (None if value is None else pytest.approx(value))
    grown = {(r.ticker, r.date): r.cumulative_return for r in cumulative_returns(simple_returns(prices)).collect()}
    for key, value in grown.items():
        assert found[key].cumulative_return == pytest.approx(value, abs=1e-9)


def test_sums_of_years_add_up(spark):
    returns = returns_frame(spark, tickers=7)
    kept = origins(returns)
    parts = [pair_sums(returns.filter(c), block=b, origin=kept) for c, b in (("date < '2020-01-01'", 2), ("date >= '2020-01-01'", 3))]

    def close(df):
        return {(r.ticker_a, r.ticker_b): (r.days, r.covariance, r.correlation) for r in df.collect()}

    whole, added = close(pair_statistics(returns)), close(statistics_of(merged_sums(*parts)))
    assert whole.keys() == added.keys()
    for pair, (days, covariance, correlation) in whole.items():
        assert added[pair][0] == days
        for a, b in zip(added[pair][1:], (covariance, correlation), strict=True):
            assert a == (None if b is None else pytest.approx(b, abs=1e-12))


def test_memory_of_a_pair_of_blocks_does_not_grow_with_years():
    """The sums of a pair of blocks are as large after forty years as after one."""
    pair = correlation._Pair(0, 1)
    days = np.arange(1, 200)

    def year(n):
        dice = np.random.default_rng(n)
        return [(b, f"T{b}{i}", days, dice.normal(size=len(days))) for b in (0, 1) for i in range(5)]

    pair.add(year(0))
    size = pair.sums.nbytes
    for n in range(1, 40):
        pair.add(year(n))
    assert pair.sums.nbytes == size and pair.sums[0].max() == 40 * len(days)


def test_portfolio_variance_from_sums_by_date(spark):
    """Tickers with the same dates are one series; the total equals that of all pairs, with missing dates and without."""
    for share in (1.0, 0.6):
        frame = returns_frame(spark, tickers=6, days=60).filter("ticker LIKE 'T%'") if share < 1 else spark.createDataFrame(
            [(f"T{t}", dt.date(2020, 1, 1) + dt.timedelta(days=d), math.sin(t * 7 + d)) for t in range(6) for d in range(60)],
            "ticker string, date date, return_value double",
        )
        assert summed_by_dates(frame).select("ticker").distinct().count() == (1 if share == 1 else 6)
        total = pair_statistics(frame).agg(F.sum("covariance")).first()[0]
        assert total_covariance(frame).first()[0] == pytest.approx(total)


def test_pairs_of_blocks_shuffle_no_copies_of_rows(spark):
    """Rows are written once, in their block: the plan of the sums deals numbers of blocks only."""
    returns = returns_frame(spark, tickers=9)
    text = pair_sums(returns, block=2)._jdf.queryExecution().executedPlan().toString()
    assert "Range" in text and "values" not in text and text.count("hashpartitioning(low") == 1
    dealt = correlation._in_blocks(correlation._from_origin(correlation._packed(returns, "return_value"), origins(returns)), F.lit(4))
    again = dealt.repartition("low", "high").sortWithinPartitions("low", "high", "year").mapInArrow(correlation._add_up, correlation.SUM_SCHEMA)

    def held(df):
        return {(r.ticker_a, r.ticker_b): tuple(r)[2:] for r in df.collect()}

    one, other = held(pair_sums(returns, block=2)), held(again)
    assert one.keys() == other.keys()
    for pair, sums in one.items():
        assert sums == pytest.approx(other[pair], abs=1e-12)


def test_small_blocks_are_read_once_a_pair_of_tiles(tmp_path, monkeypatch):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from barwright.operators import correlation

    rng = np.random.default_rng(0)
    for block in range(6):
        for year in (2020, 2021):
            folder = tmp_path / f"block={block}" / f"year={year}"
            folder.mkdir(parents=True)
            if block == 5 and year == 2021:
                continue
            rows = pa.table({"ticker": [f"T{block}{i}" for i in range(3)], "days": [list(range(1, 9))] * 3, "values": rng.normal(size=(3, 8)).tolist()})
            pq.write_table(rows.cast(pa.schema([("ticker", pa.string()), ("days", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])), folder / "a.parquet")
    reads = []
    plain = correlation._rows_of
    monkeypatch.setattr(correlation, "_rows_of", lambda system, block, paths: reads.append(block) or plain(system, block, paths))

    def sums(tile):
        reads.clear()
        tiles = -(-6 // tile)
        pairs = [(i, j) for i in range(tiles) for j in range(i, tiles)]
        asked = pa.RecordBatch.from_pydict({"low": [p[0] for p in pairs], "high": [p[1] for p in pairs]})
        out = [r for batch in correlation._add_stored(iter([asked]), str(tmp_path), tile) for r in batch.to_pylist()]
        return sorted(map(str, out)), len(reads)

    one, many = sums(1), sums(4)
    assert one[0] == many[0] and len(one[0]) == 18 * 19 // 2
    assert 3 * many[1] <= one[1]


def test_total_covariance_is_that_of_all_pairs_and_no_pair_leaves_its_task(spark, monkeypatch):
    from barwright.operators import correlation

    rows = [(f"T{t}", f"2020-0{1 + d % 9}-{1 + d:02d}", float((t * 7 + d * 3) % 11) + t) for t in range(9) for d in range(20) if (t + d) % (2 + t % 3)]
    rows += [("ALONE", "2023-05-05", 1.0), ("NONE", "2020-01-01", None)]
    returns = spark.createDataFrame(rows, "ticker string, date string, return_value double").withColumn("date", F.col("date").cast("date"))
    expected = pair_statistics(returns).agg(F.sum("covariance")).first()[0]
    for size in (2, 512):
        monkeypatch.setattr(correlation, "BLOCK", size)
        found = correlation.total_covariance_of(returns)
        assert "ticker_a" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.first()[0] == pytest.approx(expected, rel=1e-12)
    assert correlation.total_covariance_of(returns.filter("ticker = 'ALONE'")).first()[0] is None
    assert correlation.total_covariance_of(returns.limit(0)).first()[0] is None
    monkeypatch.setattr(correlation, "arrow_opens", lambda _: False)
    assert correlation.total_covariance_of(returns).first()[0] == pytest.approx(expected, rel=1e-12)
