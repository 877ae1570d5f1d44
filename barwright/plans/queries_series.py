"""Prices, returns and statistics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators.catalog import head_sample, last_rows
from barwright.operators.correlation import correlation_matrix, merged_sums, origins, pair_statistics, pair_sums, statistics_of
from barwright.operators.joblog import log_metrics, search_log
from barwright.operators.mapping import rename_migration, returns_view, with_adjusted_close
from barwright.operators.portfolio import equal_weight_portfolio, equal_weights
from barwright.operators.returns import (
    compute_returns,
    cumulative_returns,
    last_before,
    linear_return,
    log_return,
    log_returns,
    return_series,
    returns_job_log,
    simple_returns,
)
from barwright.operators.stats import annualized, period_statistics, row_totals, rows_summary
from barwright.plans import views
from barwright.plans.registry import query
from barwright.schema import RETURN_KEY, RETURNS, Field
from barwright.session import scratch_dir
from barwright.sources.prices import last_days, read_prices
from barwright.sources.table import YearTable

RETURNS_SQL = """SELECT ticker, date, p / prev - 1 AS return_value FROM (
  SELECT ticker, date, close AS p, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM {bars})
  WHERE prev IS NOT NULL"""

FILLED_SQL = """filled AS (SELECT ticker, date,
    last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM gappy),
  pairs AS (SELECT ticker, date, p, lag(p) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM filled)"""

LOG_SQL = """SELECT ticker, date, CASE WHEN prev > 0 AND p > 0 THEN ln(p / prev) END AS r FROM (
  SELECT ticker, date, close AS p, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM {bars})"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "event_daily_returns",
    f"SELECT ticker, date, round(return_value, 6) AS return_value FROM ({RETURNS_SQL.format(bars='event_bars')})",
    ("event_bars",),
)
def event_daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simple_returns(views.event_bars(spark, sf_dir)), "return_value")


@query(
    "daily_returns",
    f"SELECT ticker, date, round(return_value, 6) AS return_value FROM ({RETURNS_SQL.format(bars='bars')})",
    ("bars",),
)
def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simple_returns(views.bars(spark, sf_dir)), "return_value")


@query(
    "returns_forward_fill",
    f"""SELECT ticker, date, round(p / prev - 1, 6) AS return_value FROM
      (WITH {FILLED_SQL} SELECT * FROM pairs) WHERE prev IS NOT NULL AND prev <> 0""",
    ("gappy",),
)
def returns_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simple_returns(views.gappy(spark, sf_dir)), "return_value")


@query(
    "returns_keep_infinite",
    f"""SELECT ticker, date, CASE WHEN prev = 0 THEN 'inf' ELSE 'number' END AS kind,
      CASE WHEN prev <> 0 THEN round(p / prev - 1, 6) END AS return_value FROM
      (WITH {FILLED_SQL} SELECT * FROM pairs) WHERE prev IS NOT NULL AND NOT (prev = 0 AND p = 0)""",
    ("gappy",),
)
def returns_keep_infinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = simple_returns(views.gappy(spark, sf_dir), keep_infinite=True)
    infinite = F.col("return_value") == float("inf")
    return returns.select(
        "ticker",
        "date",
        F.when(infinite, "inf").otherwise("number").alias("kind"),
        F.when(~infinite, F.round("return_value", 6)).alias("return_value"),
    )


@query(
    "returns_in_range",
    """SELECT ticker, date, round(p / prev - 1, 6) AS return_value, 'daily' AS return_type,
      '2024-02-01 00:00:00' AS created_at FROM (
      SELECT ticker, date, close AS p, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM bars
      WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31') WHERE prev IS NOT NULL""",
    ("bars",),
)
def returns_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = F.lit("2024-02-01 00:00:00").cast("timestamp")
    found = compute_returns(views.bars(spark, sf_dir), created, start="1997-01-01", end="1998-12-31")
    return rounded(found, "return_value").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "returns_with_lookback",
    """SELECT ticker, date, round(p / prev - 1, 6) AS return_value FROM (
      SELECT ticker, date, close AS p, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM bars
      WHERE date <= DATE '1998-12-31') WHERE prev IS NOT NULL AND date >= DATE '1997-01-01'""",
    ("bars",),
)
def returns_with_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = views.bars(spark, sf_dir)
    found = compute_returns(
        prices,
        F.lit(views.FETCHED),
        start="1997-01-01",
        end="1998-12-31",
        lookback=last_before(prices, "1997-01-01"),
    )
    return rounded(found.select("ticker", "date", "return_value"), "return_value")


@query(
    "returns_merged",
    f"""SELECT coalesce(n.ticker, s.ticker) AS ticker, coalesce(n.date, s.date) AS date, 'daily' AS return_type,
      round(coalesce(n.return_value, s.return_value), 6) AS return_value,
      CASE WHEN s.ticker IS NOT NULL THEN '2023-01-01' ELSE '2024-02-01' END AS created_on
      FROM ({RETURNS_SQL.format(bars='incoming')}) n
      FULL OUTER JOIN ({RETURNS_SQL.format(bars='stored')}) s ON n.ticker = s.ticker AND n.date = s.date""",
    ("incoming", "stored"),
)
def returns_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = compute_returns(views.stored(spark, sf_dir), F.lit("2023-01-01").cast("timestamp"))
    merged = compute_returns(
        views.incoming(spark, sf_dir), F.lit("2024-02-01").cast("timestamp"), stored=old
    )
    return rounded(merged, "return_value").select(
        "ticker", "date", "return_type", "return_value", F.date_format("created_at", "yyyy-MM-dd").alias("created_on")
    )


@query(
    "returns_job_rows",
    f"""SELECT ticker, count(*) AS rows, 'success' AS status, 'returns' AS source
      FROM ({RETURNS_SQL.format(bars='bars')}) GROUP BY ticker""",
    ("bars",),
)
def returns_job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = compute_returns(views.bars(spark, sf_dir), F.lit(views.FETCHED))
    return returns_job_log(written, "job-1", views.FETCHED).select("ticker", "rows", "status", "source")


@query(
    "log_returns",
    f"SELECT ticker, date, round(r, 6) AS log_return FROM ({LOG_SQL.format(bars='gappy')})",
    ("gappy",),
)
def query_log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(log_returns(views.gappy(spark, sf_dir)), "log_return")


@query(
    "cumulative_returns",
    f"""SELECT ticker, date, round(product(1 + return_value) OVER (PARTITION BY ticker ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 6) AS cumulative_return
      FROM ({RETURNS_SQL.format(bars='bars')})""",
    ("bars",),
)
def query_cumulative_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns and what they add up to, in one pass; a row without a return has no place here."""
    series = return_series(views.bars(spark, sf_dir)).filter("return_value IS NOT NULL")
    return rounded(series.select("ticker", "date", "cumulative_return"), "cumulative_return")


@query(
    "returns_accumulated",
    f"""SELECT ticker, date, round(product(1 + return_value) OVER (PARTITION BY ticker ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 6) AS cumulative_return
      FROM ({RETURNS_SQL.format(bars='stored')})""",
    ("stored",),
)
def returns_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accumulated return of returns that are there already."""
    grown = cumulative_returns(simple_returns(views.stored(spark, sf_dir)))
    return rounded(grown.select("ticker", "date", "cumulative_return"), "cumulative_return")


@query(
    "return_series",
    f"""SELECT ticker, date, round(CASE WHEN prev <> 0 THEN p / prev - 1 END, 6) AS return_value, round(r, 6) AS log_return,
      round(product(CASE WHEN prev <> 0 THEN p / prev ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 6) AS cumulative_return
      FROM (WITH {FILLED_SQL} SELECT * FROM pairs) JOIN ({LOG_SQL.format(bars='gappy')}) l USING (ticker, date)""",
    ("gappy",),
)
def query_return_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three returns of prices with missing and zero values, in one pass."""
    return rounded(return_series(views.gappy(spark, sf_dir)), "return_value", "log_return", "cumulative_return")


@query(
    "intraday_returns",
    """SELECT ticker, date, round(close / open - 1, 6) AS linear, round(ln(close / open), 6) AS logarithmic FROM bars""",
    ("bars",),
)
def intraday_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    close, opening = F.col("close"), F.col("open")
    return views.bars(spark, sf_dir).select(
        "ticker",
        "date",
        F.round(linear_return(close, opening), 6).alias("linear"),
        F.round(log_return(close, opening), 6).alias("logarithmic"),
    )


@query(
    "period_statistics",
    f"""SELECT ticker, round(coalesce(sum(r), 0), 6) AS period_return, round(avg(r), 6) AS mean_return,
      round(stddev_samp(r), 6) AS risk FROM ({LOG_SQL.format(bars='bars')}) GROUP BY ticker""",
    ("bars",),
)
def query_period_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(period_statistics(views.bars(spark, sf_dir)), "period_return", "mean_return", "risk")


@query(
    "annualized_risk",
    f"""SELECT ticker, round(ln(pow(1 + m, 252)), 6) AS annual_log_return, round(s * sqrt(252), 6) AS annual_risk,
      round(CASE WHEN m <> 0 THEN s / m END, 3) AS variation FROM (
      SELECT ticker, avg(r) AS m, stddev_samp(r) AS s FROM ({LOG_SQL.format(bars='event_bars')}) GROUP BY ticker)""",
    ("event_bars",),
)
def annualized_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = annualized(period_statistics(views.event_bars(spark, sf_dir)))
    return full.select(
        "ticker",
        F.round(F.ln(1 + F.col("annual_return")), 6).alias("annual_log_return"),
        F.round("annual_risk", 6).alias("annual_risk"),
        F.round("variation", 3).alias("variation"),
    )


PAIRS_SQL = f"""SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, count(*) AS n,
  CASE WHEN count(*) > 1 AND var_samp(a.return_value) > 0 AND var_samp(b.return_value) > 0
    THEN corr(a.return_value, b.return_value) END AS cor,
  CASE WHEN count(*) > 1 THEN covar_samp(a.return_value, b.return_value) END AS cov
  FROM ({RETURNS_SQL.format(bars='bars')}) a JOIN ({RETURNS_SQL.format(bars='bars')}) b ON a.date = b.date
  GROUP BY ALL"""


@query(
    "return_correlation",
    f"SELECT ticker_a, ticker_b, round(cor, 6) AS correlation FROM ({PAIRS_SQL})",
    ("bars",),
)
def return_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = simple_returns(views.bars(spark, sf_dir))
    return rounded(correlation_matrix(returns), "correlation")


@query(
    "return_covariance",
    f"SELECT ticker_a, ticker_b, n AS days, round(cov, 4) AS covariance FROM ({PAIRS_SQL})",
    ("bars",),
)
def return_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pair_statistics(simple_returns(views.bars(spark, sf_dir)), block=64)
    return rounded(pairs.select("ticker_a", "ticker_b", "days", "covariance"), "covariance", digits=4)


@query(
    "equal_weights",
    f"""SELECT ticker, round(avg(return_value), 6) AS mean_return, round(1.0 / count(*) OVER (), 9) AS weight
      FROM ({RETURNS_SQL.format(bars='bars')}) GROUP BY ticker""",
    ("bars",),
)
def query_equal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = equal_weights(simple_returns(views.bars(spark, sf_dir)))
    return weights.select("ticker", F.round("mean_return", 6).alias("mean_return"), F.round("weight", 9).alias("weight"))


@query(
    "correlation_of_added_years",
    f"SELECT ticker_a, ticker_b, n AS days, round(cor, 6) AS correlation, round(cov, 4) AS covariance FROM ({PAIRS_SQL})",
    ("bars",),
)
def correlation_of_added_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums of early years are stored; a later year is summed alone and added."""
    returns = simple_returns(views.bars(spark, sf_dir))
    folder = scratch_dir(spark, "sums")
    early, late = returns.filter("date < DATE '1997-01-01'"), returns.filter("date >= DATE '1997-01-01'")
    first = origins(returns)
    first.write.parquet(f"{folder}/origins")
    kept = spark.read.schema(first.schema).parquet(f"{folder}/origins")
    pair_sums(early, block=64, origin=kept).write.parquet(f"{folder}/sums")
    stored = spark.read.parquet(f"{folder}/sums")
    pairs = statistics_of(merged_sums(stored, pair_sums(late, origin=kept)))
    return pairs.select("ticker_a", "ticker_b", "days", F.round("correlation", 6).alias("correlation"), F.round("covariance", 4).alias("covariance"))


def portfolio_sql(bars: str, settings: str, condition: str) -> str:
    point = "ticker || '|' || strftime(date, '%Y-%m-%d') || '|' || CAST(CAST(round(return_value, 10) AS DECIMAL(28,10)) AS VARCHAR)"
    words = " || ',' || ".join(f"CAST(sum(CAST(('0x' || substr(h, {8 * i + 1}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(8))
    return f"""SELECT * FROM (WITH r AS (SELECT * FROM ({RETURNS_SQL.format(bars=bars)}) WHERE {condition}),
      m AS (SELECT ticker, avg(return_value) AS m FROM r GROUP BY ticker),
      c AS (SELECT sum(c) AS c FROM (SELECT covar_samp(a.return_value, b.return_value) AS c FROM r a JOIN r b
        ON a.date = b.date GROUP BY a.ticker, b.ticker HAVING count(*) > 1)),
      f AS (SELECT sha256(CAST(count(*) AS VARCHAR) || ',' || {words}) AS f FROM (SELECT sha256({point}) AS h FROM r)),
      p AS (SELECT count(*) AS n, avg(m) * 252 AS e FROM m)
      SELECT sha256('{settings}|' || f) AS run_id, n AS tickers, round(1.0 / n, 6) AS weight, round(e, 4) AS expected_return,
        round(sqrt(c / (n * n) * 252), 4) AS volatility, round(e / sqrt(c / (n * n) * 252), 4) AS sharpe
      FROM p, c, f)"""


def shown_portfolio(portfolio: DataFrame) -> DataFrame:
    return portfolio.select(
        "run_id",
        "tickers",
        F.round("weight", 6).alias("weight"),
        *(F.round(c, 4).alias(c) for c in ("expected_return", "volatility", "sharpe")),
    )


@query(
    "equal_weight_portfolio",
    portfolio_sql("event_bars", "equal|2024-01-30|20|252", "date <= DATE '2024-01-30' AND date > DATE '2024-01-10'"),
    ("event_bars",),
)
def query_equal_weight_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = simple_returns(views.event_bars(spark, sf_dir))
    return shown_portfolio(equal_weight_portfolio(returns, date(2024, 1, 30), lookback_days=20))


@query(
    "portfolio_of_all_tickers",
    portfolio_sql("bars", "equal|1998-08-01|None|252", "date <= DATE '1998-08-01'"),
    ("bars",),
)
def portfolio_of_all_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tickers of the table, each with dates of its own."""
    return shown_portfolio(equal_weight_portfolio(simple_returns(views.bars(spark, sf_dir)), date(1998, 8, 1)))


@query(
    "prices_in_range",
    """SELECT ticker, date, close, volume FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""",
    ("bars",),
)
def prices_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_prices(
        views.bars(spark, sf_dir), None, "1996-01-01", "1999-12-31", ["ticker", "date", "close", "volume"]
    )


@query(
    "prices_since",
    "SELECT ticker, date, close FROM bars WHERE date >= DATE '1999-12-31'",
    ("bars",),
)
def prices_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_prices(views.bars(spark, sf_dir), start="1999-12-31", columns=["ticker", "date", "close"])


@query(
    "sample_pull",
    """SELECT ticker, date, open, high, low, close, volume FROM bars
      WHERE date BETWEEN DATE '2000-06-01' AND DATE '2000-07-01'""",
    ("bars",),
)
def sample_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_days(views.bars(spark, sf_dir), views.AS_OF.date(), 30)


@query(
    "newest_rows",
    "SELECT ticker, date, close FROM bars ORDER BY date DESC, ticker, close LIMIT 10",
    ("bars",),
)
def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_rows(views.bars(spark, sf_dir).select("ticker", "date", "close"), 10)


@query(
    "first_rows",
    "SELECT ticker, date, close FROM bars ORDER BY ticker, date LIMIT 5",
    ("bars",),
)
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head_sample(views.bars(spark, sf_dir).select("ticker", "date", "close"))


@query(
    "row_totals",
    "SELECT ticker, count(*) AS rows, min(date) AS min_date, max(date) AS max_date FROM bars GROUP BY ticker",
    ("bars",),
)
def query_row_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_totals(views.bars(spark, sf_dir))


@query(
    "rows_summary",
    """SELECT ticker, '{"min_date":"' || min(date) || '","max_date":"' || max(date) || '","count":' || count(*) || '}'
      AS rows_summary FROM bars GROUP BY ticker""",
    ("bars",),
)
def query_rows_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_summary(views.bars(spark, sf_dir)).withColumn("rows_summary", F.to_json("rows_summary"))


@query(
    "adjusted_close",
    "SELECT ticker, date, close, close AS adj_close FROM bars",
    ("bars",),
)
def adjusted_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_adjusted_close(views.bars(spark, sf_dir).select("ticker", "date", "close"))


@query(
    "returns_view",
    f"""SELECT ticker, date, round(return_value, 6) AS "return" FROM ({RETURNS_SQL.format(bars='bars')})""",
    ("bars",),
)
def query_returns_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns_view(rounded(simple_returns(views.bars(spark, sf_dir)), "return_value"))


@query(
    "rename_migration",
    f"""SELECT ticker, date, round(return_value, 6) AS return_value FROM ({RETURNS_SQL.format(bars='bars')})""",
    ("bars",),
)
def query_rename_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = rounded(simple_returns(views.bars(spark, sf_dir)), "return_value")
    return rename_migration(returns_view(old), "return", "return_value")


@query(
    "migrated_returns",
    f"""SELECT ticker, date, round(return_value, 6) AS "return", 'daily' AS return_type, 'kept' AS note, round(return_value, 6) AS before
      FROM ({RETURNS_SQL.format(bars='bars')})""",
    ("bars",),
)
def migrated_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table whose column is renamed and which gains another; the version before it is still read by its own columns."""
    table = YearTable(spark, f"{scratch_dir(spark, 'migrate')}/returns", RETURNS, RETURN_KEY)
    returns = rounded(compute_returns(views.bars(spark, sf_dir), views.FETCHED), "return_value")
    first = table.upsert(returns)
    renamed = [Field("return", f.kind, f.nullable) if f.name == "return_value" else f for f in RETURNS]
    table.migrate((*renamed, Field("note", "string")), lambda rows: rename_migration(rows, "return_value", "return").withColumn("note", F.lit("kept")))
    old = table.read(version=first).select("ticker", "date", F.col("return_value").alias("before"))
    return table.read().join(old, ["ticker", "date"], "full_outer").select("ticker", "date", "return", "return_type", "note", "before")


METRICS_SQL = """count(*) AS jobs, round(avg(date_diff('second', started_at, finished_at)), 4) AS mean_latency,
  round(avg(CASE WHEN status = 'error' THEN 1 ELSE 0 END), 6) AS error_rate, CAST(sum(rows) AS BIGINT) AS rows_fetched
  FROM job_log"""


@query("log_metrics_by_ticker", f"SELECT ticker, {METRICS_SQL} GROUP BY ticker", ("job_log",))
def log_metrics_by_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = log_metrics(views.job_log(spark, sf_dir))
    return rounded(rounded(metrics, "mean_latency", digits=4), "error_rate")


@query("log_metrics_by_source", f"SELECT source, {METRICS_SQL} GROUP BY source", ("job_log",))
def log_metrics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = log_metrics(views.job_log(spark, sf_dir), ("source",))
    return rounded(rounded(metrics, "mean_latency", digits=4), "error_rate")


@query(
    "log_search",
    """SELECT ticker, job_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, rows AS rows_fetched, status,
      error_message, CAST(date_diff('second', started_at, finished_at) * 1000 AS BIGINT) AS duration_ms
      FROM job_log WHERE status = 'error' AND started_at >= TIMESTAMP '2024-01-10'
      ORDER BY started_at, job_id LIMIT 50 OFFSET 100""",
    ("job_log",),
)
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_log(views.job_log(spark, sf_dir), status="error", since="2024-01-10", limit=50, offset=100)
    return found.withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss")).drop("finished_at")


@query(
    "log_search_next_page",
    """SELECT ticker, job_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, rows AS rows_fetched, error_message FROM job_log
      WHERE status = 'error' AND (started_at, job_id) > (SELECT (started_at, job_id) FROM job_log WHERE status = 'error'
        ORDER BY started_at, job_id LIMIT 1 OFFSET 49) ORDER BY job_log.started_at, job_log.job_id LIMIT 50""",
    ("job_log",),
)
def log_search_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the errors, found by the last entry of the first."""
    log = views.job_log(spark, sf_dir)
    last = search_log(log, status="error", limit=50).agg(F.max(F.struct("started_at", "job_id")).alias("m")).select("m.*").first()
    page = search_log(log, status="error", limit=50, after=(last["started_at"], last["job_id"]))
    return page.select("ticker", "job_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "rows_fetched", "error_message")


@query(
    "adjusted_returns",
    """SELECT ticker, date, round(p / prev - 1, 6) AS return_value FROM (SELECT ticker, date, close * 2 + volume AS p,
      lag(close * 2 + volume) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM bars) WHERE prev IS NOT NULL""",
    ("bars",),
)
def adjusted_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns take the adjusted close where a table has one."""
    prices = views.bars(spark, sf_dir).withColumn("adj_close", F.col("close") * 2 + F.col("volume"))
    return rounded(simple_returns(prices), "return_value")
