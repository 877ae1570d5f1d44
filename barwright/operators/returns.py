"""Returns of all tickers in one job."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions.tickers import returns_ticker
from barwright.operators.diff import merge_returns
from barwright.operators.mapping import price_column, quoted
from barwright.operators.series import with_growth, with_lag, with_previous_filled, with_running_product
from barwright.schema import no_nan
from barwright.sources.prices import read_prices


def linear_return(final: Column, initial: Column) -> Column:
    """``final / initial - 1``; null when the initial price is zero."""
    return F.try_divide(final, initial) - 1


def log_return(final: Column, initial: Column) -> Column:
    """``ln(final / initial)``; null when the ratio is not positive."""
    return F.ln(F.try_divide(final, initial))


def simple_returns(prices: DataFrame, price: str | None = None, keep_infinite: bool = False) -> DataFrame:
    """``ticker, date, return_value`` of every row that has a return.

    A missing price takes the last one before it, as a forward fill. After a zero price there is no return;
    with ``keep_infinite`` it is infinite instead, and only zero over zero has none.
    """
    price = price or price_column(prices)
    series = prices.select("ticker", "date", no_nan(quoted(price).cast("double")).alias("_price"))
    paired = with_previous_filled(series, "_price", "_previous")
    current, previous = F.coalesce("_price", "_previous"), F.col("_previous")
    value = linear_return(current, previous)
    if keep_infinite:
        sign = F.when(current > 0, F.lit(float("inf"))).when(current < 0, F.lit(float("-inf")))
        value = F.when(previous == 0, sign).otherwise(value)
    return paired.select("ticker", "date", value.alias("return_value")).filter("return_value IS NOT NULL")


def log_returns(prices: DataFrame, price: str | None = None) -> DataFrame:
    """Every row with the log return against the row before; null where either price is missing."""
    price = price or price_column(prices)
    series = prices.select("ticker", "date", no_nan(quoted(price).cast("double")).alias("_price"))
    paired = with_lag(series, "_price", "_previous")
    value = log_return(F.col("_price"), F.col("_previous"))
    return paired.select("ticker", "date", value.alias("log_return"))


def return_series(prices: DataFrame, price: str | None = None) -> DataFrame:
    """``ticker, date, return_value, log_return, cumulative_return`` of every row, in one pass over the prices.

    The columns are those of :func:`simple_returns`, :func:`log_returns` and :func:`cumulative_returns`; a row without a simple
    return has none of the first, and the accumulated return of the rows before it.
    """
    price = price or price_column(prices)
    series = prices.select("ticker", "date", no_nan(quoted(price).cast("double")).alias("_price"))
    grown = with_growth(series, "_price")
    return grown.select(
        "ticker",
        "date",
        linear_return(F.coalesce("_price", "_filled"), F.col("_filled")).alias("return_value"),
        log_return(F.col("_price"), F.col("_lag")).alias("log_return"),
        (F.col("_growth") - 1).alias("cumulative_return"),
    )


def cumulative_returns(returns: DataFrame) -> DataFrame:
    """Add the return accumulated since the first row of the ticker: the product of ``1 + r``, minus one."""
    grown = with_running_product(returns, 1 + F.col("return_value"), "_growth")
    return grown.withColumn("cumulative_return", F.col("_growth") - 1).drop("_growth")


def shape_returns(returns: DataFrame, created_at: datetime | Column, return_type: str = "daily") -> DataFrame:
    """The rows as the returns table holds them."""
    return returns.select(
        returns_ticker(F.col("ticker")).alias("ticker"),
        "date",
        "return_value",
        F.lit(return_type).alias("return_type"),
        (F.lit(created_at) if isinstance(created_at, datetime) else created_at)
        .cast("timestamp")
        .alias("created_at"),
    )


def compute_returns(
    prices: DataFrame,
    created_at: datetime | Column,
    tickers: list[str] | None = None,
    start: date | str | None = None,
    end: date | str | None = None,
    stored: DataFrame | None = None,
    lookback: DataFrame | None = None,
) -> DataFrame:
    """Read the range, compute the daily returns of all tickers or the named ones, merge them into ``stored``.

    The range is applied before the returns, so its first row has none. Give ``lookback`` (one row per ticker,
    the last one before ``start``) to keep that return. Without ``stored`` this is the dry run: the rows that
    would be written.
    """
    selected = read_prices(prices, tickers, start, end)
    if lookback is not None:
        selected = selected.unionByName(lookback.select(*selected.columns))
    fresh = shape_returns(simple_returns(selected), created_at)
    return fresh if stored is None else merge_returns(stored, fresh)


def last_before(prices: DataFrame, start: date | str) -> DataFrame:
    """The last row of every ticker before ``start``, for :func:`compute_returns`."""
    rest = [c for c in prices.columns if c not in ("ticker", "date")]
    return (
        prices.filter(F.col("date") < F.lit(start).cast("date"))
        .groupBy("ticker")
        .agg(F.max(F.struct("date", *rest)).alias("_row"))
        .select(*(F.col("ticker") if c == "ticker" else F.col(f"_row.{c}") for c in prices.columns))
    )


def returns_job_log(returns: DataFrame, job_id: str, at: datetime | Column) -> DataFrame:
    """One job row per ticker with the number of rows written."""
    instant = F.lit(at) if isinstance(at, datetime) else at
    return returns.groupBy("ticker").agg(F.count("*").alias("rows")).select(
        F.lit(job_id).alias("job_id"),
        "ticker",
        F.lit("returns").alias("source"),
        F.lit("success").alias("status"),
        instant.cast("timestamp").alias("started_at"),
        instant.cast("timestamp").alias("finished_at"),
        "rows",
        F.lit(None).cast("string").alias("error_message"),
        F.to_json(F.struct(F.lit("compute_returns").alias("action"))).alias("extras"),
    )
