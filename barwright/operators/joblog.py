"""Metrics and search over the ingest job log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _seconds(start: str = "started_at", end: str = "finished_at"):
    return (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000


def log_metrics(log: DataFrame, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Jobs, mean latency in seconds, share of errors and rows fetched per ticker or source."""
    return log.groupBy(*by).agg(
        F.count("*").alias("jobs"),
        F.avg(_seconds()).alias("mean_latency"),
        F.avg((F.col("status") == "error").cast("int")).alias("error_rate"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_fetched"),
    )


def search_log(
    log: DataFrame,
    ticker: str | None = None,
    status: str | None = None,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
    limit: int | None = None,
    offset: int = 0,
    after: tuple[datetime | str, str] | None = None,
) -> DataFrame:
    """Log entries that match, oldest first, one page of them when ``limit`` is given.

    ``after`` is ``(started_at, job_id)`` of the last entry of the page before: entries up to it are filtered out where they lie,
    while an ``offset`` has to sort and skip them.
    """
    found = log
    for column, value in (("ticker", ticker), ("status", status)):
        if value is not None:
            found = found.filter(F.col(column) == value)
    if since is not None:
        found = found.filter(F.col("started_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        found = found.filter(F.col("started_at") < F.lit(until).cast("timestamp"))
    if after is not None:
        last = F.lit(after[0]).cast("timestamp")
        found = found.filter((F.col("started_at") > last) | ((F.col("started_at") == last) & (F.col("job_id") > after[1])))
    found = found.select(
        "ticker",
        "job_id",
        "started_at",
        "finished_at",
        F.col("rows").alias("rows_fetched"),
        "status",
        "error_message",
        F.round(_seconds() * 1000).cast("long").alias("duration_ms"),
    )
    if limit is None and not offset:
        return found
    page = found.orderBy("started_at", "job_id")
    if offset:
        page = page.offset(offset)
    return page if limit is None else page.limit(limit)
