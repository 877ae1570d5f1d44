"""The audit log: what an ingest has pulled, refused and found wrong, one event a row.

Events are recorded per job (:class:`barwright.sources.log.RunLog`): a job that is run again replaces its own events, so
the log holds each job once, however often it was tried.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions.dates import stamp_of
from barwright.functions.fingerprints import group_fingerprint
from barwright.operators.quality import feed_problems, validation_events
from barwright.schema import ERROR_TYPE
from barwright.sources.files import file_facts, write_sidecars
from barwright.sources.log import RunLog
from barwright.sources.prices import write_raw_feed

# Kinds of events, and the reason code of a feed that is refused as a whole.
INVALID_ROWS, FEED_PROBLEM, RAW_PULL, JOB = "invalid_rows", "feed_problem", "raw_pull", "job"
FEED_VALIDATION = "ADAPTER_VALIDATION"

DETAIL = "struct<row: string, " + ERROR_TYPE.removeprefix("struct<")
AUDIT = (
    "kind string, job_id string, provider string, ticker string, raw_file string, invalid_filepath string, invalid_count long, "
    f"part long, parts long, error_details array<{DETAIL}>, rows long, raw_checksum string, file_checksum string, "
    "size_bytes long, status string, error_message string, started_at timestamp, finished_at timestamp, created_at timestamp"
)


class AuditLog(RunLog):
    """The events of all jobs."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__(spark, root, AUDIT)

    def record(self, run_id: str, entries: DataFrame) -> None:
        """Write a job's events; columns that a kind of event does not have are null."""
        missing = [f for f in self.schema.fields if f.name not in entries.columns]
        super().record(run_id, entries.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}))

    def events(self, kind: str | None = None, job_id: str | None = None) -> DataFrame:
        """The events, of one kind or job if that is given."""
        found = self.read()
        for column, wanted in (("kind", kind), ("job_id", job_id)):
            if wanted is not None:
                found = found.filter(F.col(column) == wanted)
        return found


def _instant(at: datetime | Column) -> Column:
    return (F.lit(at) if isinstance(at, datetime) else at).cast("timestamp")


def invalid_row_events(
    annotated: DataFrame,
    job_id: str,
    at: datetime,
    row: str,
    raw_file: Column | None = None,
    invalid_filepath: Column | None = None,
    by: tuple[str, ...] = ("provider", "ticker"),
    details_per_event: int = 1000,
) -> DataFrame:
    """One event per provider and ticker (several parts of a large one) with every error of its invalid rows.

    ``row`` is the column that names a row in the details. ``raw_file`` and ``invalid_filepath`` are expressions over ``by``.
    """
    named = annotated.select(*by, F.col(row).cast("string").alias("_row"), "errors")
    events = validation_events(named, by, ("_row",), details_per_event)

    def flat(entry: Column) -> Column:
        parts = ("column", "reason_code", "reason_message", "failure_value")
        return F.transform(entry["errors"], lambda e: F.struct(entry["_row"].alias("row"), *(e[p].alias(p) for p in parts)))

    empty = F.lit("")
    return events.select(
        F.lit(INVALID_ROWS).alias("kind"), F.lit(job_id).alias("job_id"), *by, "invalid_count", "part", "parts",
        (empty if raw_file is None else raw_file).alias("raw_file"),
        (empty if invalid_filepath is None else invalid_filepath).alias("invalid_filepath"),
        F.flatten(F.transform("error_details", flat)).alias("error_details"),
        F.lit("error").alias("status"), _instant(at).alias("created_at"),
    )


def feed_problem_events(
    spark: SparkSession, feed: DataFrame, job_id: str, at: datetime, provider: str, ticker: str = ""
) -> DataFrame:
    """One event for a feed that cannot be used as a whole, with its problems; none for a sound one."""
    details = [(None, None, FEED_VALIDATION, problem, None) for problem in feed_problems(feed)]
    rows = [(details,)] if details else []
    found = spark.createDataFrame(rows, f"error_details array<{DETAIL}>")
    return found.select(
        F.lit(FEED_PROBLEM).alias("kind"), F.lit(job_id).alias("job_id"), F.lit(provider).alias("provider"), F.lit(ticker).alias("ticker"),
        F.lit("").alias("raw_file"), F.lit("").alias("invalid_filepath"), F.size("error_details").cast("long").alias("invalid_count"),
        "error_details", F.lit("error").alias("status"), _instant(at).alias("created_at"),
    )


def save_raw(
    spark: SparkSession,
    feed: DataFrame,
    folder: str,
    stamp: str | datetime,
    job_id: str,
    at: datetime,
    by: tuple[str, ...] = ("provider", "ticker"),
) -> DataFrame:
    """Write a raw feed with a ``.checksum`` beside every file; returns one audit event per feed and file.

    The event names the file, its bytes' hash and size, and the number of rows and the fingerprint of the feed's values. ``folder`` may
    hold earlier pulls; ``stamp``, a compact stamp or a time with its zone, names this one, and the same pull again replaces its files.
    """
    stamp = stamp_of(stamp)
    write_raw_feed(feed, folder, stamp, by)
    pulled = file_facts(spark, folder, "*.csv").filter(F.col("path").contains(f"/ingest_ts={stamp}/") & F.col("error").isNull())
    report = f"{folder}/_reports/{job_id}"
    write_sidecars(pulled).write.mode("overwrite").parquet(report)  # sidecars are written once, before anything names them
    files = spark.read.parquet(report)
    for column in by:
        part = F.regexp_extract("path", f"/{column}=([^/]*)/", 1)
        files = files.withColumn(column, F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))))
    raw = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in feed.columns)), 256)
    named = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__")).alias(c) for c in by]
    feeds = feed.groupBy(*named).agg(F.count("*").alias("rows"), group_fingerprint(raw).alias("raw_checksum"))
    instant = _instant(at)
    return files.join(feeds, list(by), "left").select(
        F.lit(RAW_PULL).alias("kind"), F.lit(job_id).alias("job_id"), *by, F.col("path").alias("raw_file"), "rows", "raw_checksum",
        F.col("sha256").alias("file_checksum"), "size_bytes", F.lit("success").alias("status"),
        instant.alias("started_at"), instant.alias("finished_at"), instant.alias("created_at"),
    )


def job_events(jobs: DataFrame, at: datetime) -> DataFrame:
    """Job rows (``job_id, ticker, source, status, started_at, finished_at, rows, error_message``) as audit events."""
    return jobs.select(
        F.lit(JOB).alias("kind"), "job_id", F.col("source").alias("provider"), "ticker", "rows", "status", "error_message",
        "started_at", "finished_at", _instant(at).alias("created_at"),
    )
