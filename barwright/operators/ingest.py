"""Incremental ingest of whole snapshots, all tickers in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.functions.dates import feed_date, lenient_date
from barwright.functions.fingerprints import row_checksum
from barwright.functions.paths import plain_path
from barwright.functions.tickers import lenient_ticker
from barwright.operators.catalog import latest_per_ticker
from barwright.operators.diff import (
    cache_decisions,
    change_counts,
    classify,
    date_bounds,
    file_cache_decisions,
    last_per_key,
    listing_decisions,
    rows_to_refresh,
    ticker_fingerprints,
)
from barwright.operators.integrity import sidecar_status
from barwright.operators.mapping import MappingError, find_column, quoted, to_canonical
from barwright.operators.quality import MALFORMED_LINE, Rule, annotate, valid_rows
from barwright.schema import PRICES, names
from barwright.sources.files import arrow_opens, facts_of, file_facts, file_hashes, listed_files, sidecar_hashes, tasks_for, write_sidecars
from barwright.sources.log import PROCESSED, ProcessedFiles
from barwright.sources.prices import (
    AS_GIVEN,
    INPUT_ORDER,
    export_json,
    headers_of,
    read_csv_files,
    read_generations,
    read_grouped_csv,
    read_snapshot,
    write_snapshot,
)
from barwright.sources.table import YearTable


@dataclass(frozen=True)
class IngestResult:
    """What an ingest did: the published version and rows ``ticker, decision, processed_rows, skipped_rows``."""

    version: int
    report: DataFrame


def checked_rows(raw: DataFrame, fetched_at: datetime, source: str = "snapshot") -> DataFrame:
    """Snapshot rows with the stored ticker form, defaults for missing metadata, and their errors."""
    defaults = {
        "source": F.lit(source),
        "fetched_at": F.lit(fetched_at).cast("timestamp"),
        "raw_checksum": F.lit("pending"),  # the row checksum replaces it once the values are typed
    }
    given = {name: F.col(name) if name in raw.columns else F.lit(None) for name in defaults}
    filled = raw.withColumns({name: F.coalesce(given[name], value) for name, value in defaults.items()})
    rules = ()
    if "_corrupt" in raw.columns:
        rules = (Rule(None, MALFORMED_LINE, "line does not fit the header", F.col("_corrupt").isNotNull(), F.col("_corrupt")),)
    return annotate(filled.withColumn("ticker", lenient_ticker(F.nullif(F.trim("ticker"), F.lit("")))), extra_rules=rules)


def finished_rows(valid: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Valid rows in canonical form, with their row checksum and the columns to ``keep``."""
    typed = valid.withColumn("raw_checksum", row_checksum())
    return typed.select(*(F.col(f.name).cast(f.spark_type).alias(f.name) for f in PRICES), *keep)


def last_input_rows(finished: DataFrame) -> DataFrame:
    """One row per key: the one fetched last, then the one that stands last in the input (:data:`INPUT_ORDER`)."""
    return last_per_key(finished, sequence=("fetched_at", *INPUT_ORDER))


def canonical_rows(raw: DataFrame, fetched_at: datetime, source: str = "snapshot") -> DataFrame:
    """The valid snapshot rows in canonical form."""
    return finished_rows(valid_rows(checked_rows(raw, fetched_at, source)))


def staged(spark: SparkSession, df: DataFrame, path: str, mode: str = "errorifexists", by: tuple[str, ...] = ()) -> DataFrame:
    """Write a frame that several steps need and read it back, so that it is computed once."""
    # checksums are half of a row, and only entropy coding makes them smaller
    df.write.mode(mode).option("partitionOverwriteMode", "static").option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apply_changes(
    table: YearTable,
    incoming: DataFrame,
    folder: str,
    source: str | None = None,
    batch_id: int = -1,
    mode: str = "errorifexists",
    by: tuple[str, ...] = ("ticker",),
    bounds: tuple | None = None,
) -> tuple[int, DataFrame]:
    """Write the new and changed rows of a frame in stored form and unique by key; returns version and counts per group.

    The compared rows are kept in ``folder``, split by what is to be done with them: the comparison runs once, and
    the counts describe the state before the upsert. Only stored units in the incoming date range are listed; ``bounds``
    gives that range where the caller knows it.
    """
    low, high = date_bounds(incoming) if bounds is None else bounds
    stored = table.read(start=low, end=high) if low is not None else table.read().limit(0)
    compared = staged(table.spark, classify(incoming, stored), f"{folder}/changes", mode, ("change_type",))
    changed = compared.filter("change_type != 'unchanged'")
    known = compared.filter("change_type = 'changed'")
    version = table.upsert(changed, source=source, batch_id=batch_id, prepared=True, replacing=known)
    return version, change_counts(compared, by)


def file_counts(checked: DataFrame, applied: DataFrame) -> DataFrame:
    """Per file ``path, rows, processed_rows, skipped_rows, superseded_rows, invalid_rows``: every input row is in one of the four."""
    totals = checked.groupBy("_path").agg(F.count("*").alias("rows"), F.count_if(~F.col("is_valid")).alias("invalid_rows"))
    none = F.lit(0).cast("long")
    joined = totals.join(applied, "_path", "left").select(
        F.col("_path").alias("path"),
        "rows",
        F.coalesce("processed_rows", none).alias("processed_rows"),
        F.coalesce("skipped_rows", none).alias("skipped_rows"),
        "invalid_rows",
    )
    left_over = F.col("rows") - F.col("processed_rows") - F.col("skipped_rows") - F.col("invalid_rows")
    return joined.withColumn("superseded_rows", left_over)


def ingest_snapshot(
    spark: SparkSession,
    rows: DataFrame,
    table: YearTable,
    catalog: DataFrame,
    folder: str,
    as_of: datetime,
    ttl_seconds: float = 0,
    force: bool = False,
) -> IngestResult:
    """Cache decision per ticker, snapshot files for the ones to refresh, then diff and upsert.

    ``folder`` must be new: it keeps the canonical rows, the decisions, the snapshot files and the compared rows.
    """
    canonical = staged(
        spark,
        last_per_key(
            rows.select(*names(PRICES)).withColumn("ticker", lenient_ticker(F.col("ticker"))), sequence=("fetched_at",)
        ),
        f"{folder}/canonical",
    )
    last = latest_per_ticker(catalog).select(
        "ticker", F.col("checksum").alias("last_checksum"), F.col("created_at").alias("generated_at")
    )
    decisions = staged(
        spark,
        cache_decisions(ticker_fingerprints(canonical), last, as_of, ttl_seconds, force),
        f"{folder}/decisions",
    )
    fresh = rows_to_refresh(canonical, decisions)
    write_snapshot(fresh, f"{folder}/snapshot")
    version, counts = apply_changes(table, fresh, folder)
    report = decisions.join(counts, "ticker", "left").na.fill(0, ["processed_rows", "skipped_rows"])
    return IngestResult(version, report)


def catalog_entries(report: DataFrame, folder: str, as_of: datetime) -> DataFrame:
    """Catalog rows for the tickers an ingest refreshed."""
    stamp = as_of.strftime("%Y%m%dT%H%M%SZ")
    path = F.concat(F.lit(f"{folder}/snapshot/_ticker="), F.col("ticker"))
    payload = F.to_json(F.struct(F.lit(as_of.isoformat()).alias("generated_at"), F.col("checksum").alias("sha256")))
    none = F.lit(None)
    return report.filter("decision = 'miss'").select(
        F.concat_ws("-", "ticker", F.lit(stamp)).alias("id"),
        "ticker",
        F.lit(as_of).cast("timestamp").alias("created_at"),
        payload.alias("payload"),
        path.alias("snapshot_path"),
        "rows",
        "checksum",
        none.cast("string").alias("job_id"),
        none.cast("long").alias("size_bytes"),
        F.lit(False).alias("archived"),
        none.cast("timestamp").alias("archived_at"),
    )


def create_snapshots(
    spark: SparkSession, prices: DataFrame, folder: str, as_of: datetime, job_id: str | None = None
) -> DataFrame:
    """Snapshot files of every ticker with their ``.checksum`` files; returns the catalog rows.

    Rows and checksum of a catalog row are those of the rows as the files give them back, the size is that of the
    files. ``folder`` must be new; it also keeps the report of the hashing, so the files are hashed once.
    """
    write_snapshot(prices, f"{folder}/snapshot")
    report = staged(spark, write_sidecars(file_hashes(spark, f"{folder}/snapshot", "*.csv")), f"{folder}/sidecars")
    ticker = F.url_decode(F.replace(F.regexp_extract("path", "/_ticker=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    sizes = report.groupBy(ticker.alias("ticker")).agg(F.sum("size_bytes").alias("_size"))
    rows = read_snapshot(spark, f"{folder}/snapshot")
    entries = catalog_entries(ticker_fingerprints(rows).withColumn("decision", F.lit("miss")), folder, as_of)
    sized = entries.join(sizes, "ticker", "left").withColumns({"size_bytes": F.col("_size"), "job_id": F.lit(job_id).cast("string")})
    return sized.select(*entries.columns)


def latest_snapshots_of(catalog: DataFrame) -> DataFrame:
    """``ticker, checksum, _ticker_folder, _generation`` of the latest live snapshot of every ticker."""
    latest = latest_per_ticker(catalog.filter(~F.coalesce("archived", F.lit(False))))
    path = plain_path(F.col("snapshot_path"))
    return latest.select("ticker", "checksum", path.alias("_ticker_folder"), F.regexp_replace(path, "/[^/]+$", "").alias("_generation"))


def latest_snapshot_rows(spark: SparkSession, catalog: DataFrame) -> DataFrame:
    """The rows of the latest live snapshot of every ticker; ready for an export.

    The catalog decides what is listed: only generations (folders of one run) that are the latest of some ticker. The driver holds
    their names, one a run of :func:`create_snapshots`.
    """
    latest = latest_snapshots_of(catalog)
    generations = sorted(r[0] for r in latest.select("_generation").distinct().collect())
    wanted = latest.select(F.col("_ticker_folder").alias("_folder"))
    return read_generations(spark, generations, only=wanted).select(*names(PRICES))


def latest_snapshot_json(spark: SparkSession, catalog: DataFrame, path: str) -> None:
    """Export the latest snapshots as JSON documents, with the checksum that the catalog has for each."""
    export_json(latest_snapshot_rows(spark, catalog), latest_snapshots_of(catalog), path)


def _kept(processed: DataFrame | ProcessedFiles | None, spark: SparkSession) -> DataFrame:
    """Entries of processed files with all columns; a plain frame of hashes knows no sizes and times."""
    if isinstance(processed, ProcessedFiles):
        return processed.newest()
    columns = T.StructType.fromDDL(PROCESSED)
    empty = spark.createDataFrame([], columns)
    return empty if processed is None else processed.unionByName(empty, allowMissingColumns=True).select(*columns.names)


def _unknown_facts(spark: SparkSession, folder: str, files: DataFrame, count: int, place: Callable[[str], str], mode: str) -> DataFrame:
    """The facts of listed files, with ``expected``, the hash that a sidecar gives; each file is opened once."""
    if arrow_opens(folder):
        return staged(spark, facts_of(files, tasks_for(count)), place("facts"), mode)
    named = [r["path"] for r in files.select("path").collect()]
    facts = staged(spark, file_facts(spark, named), place("facts"), mode)
    names_of = F.concat(F.col("path"), F.lit(".checksum"))
    beside = facts.select(names_of.alias("path")).join(listed_files(spark, folder, "*.checksum"), "path", "left_semi")
    return facts.join(sidecar_hashes(spark, [r["path"] for r in beside.collect()]), "path", "left")


def ingest_files(
    spark: SparkSession,
    folder: str,
    listing: DataFrame,
    table: YearTable,
    processed: DataFrame | ProcessedFiles | None,
    place: Callable[[str], str],
    as_of: datetime,
    run_id: str,
    ttl_seconds: float | None = None,
    source: str | None = None,
    batch_id: int = -1,
    mode: str = "errorifexists",
) -> IngestResult:
    """Ingest the files of ``listing(path, size_bytes, modified)`` below ``folder``; every file is opened as late and as rarely as can be.

    The listing decides which files an entry of the same size and time covers. The others are hashed, with their header, and
    compared with their sidecars and with the entries' hashes. What is left is parsed once, each file by its own header.
    Refused files, with the reason, and rows that are invalid stay below ``place(...)``.
    """
    known = None if processed is None else _kept(processed, spark)
    unknown, report = listing, None
    if known is not None:
        listed = staged(spark, listing_decisions(listing, known, as_of, ttl_seconds), place("listing"), mode)
        report = listed.filter("cached").select("path", "size_bytes", "modified", "sha256", F.lit("cached").alias("decision"), F.lit(None).cast("string").alias("reason"))
        unknown = listed.filter("NOT cached")
    n_unknown = unknown.count()
    raw = read_grouped_csv(spark, [])
    if n_unknown or report is None:
        facts = _unknown_facts(spark, folder, unknown, n_unknown, place, mode)
        if known is None:
            facts = facts.withColumn("cached", F.lit(False))
        else:
            cached = file_cache_decisions(facts.select("path", "sha256"), known, as_of, ttl_seconds).select("path", "cached")
            facts = facts.join(cached, "path")
        decision = (
            F.when(F.col("error").isNotNull(), "unreadable")
            .when(sidecar_status() == "mismatch", "bad_checksum")
            .when(F.col("cached"), "cached")
            .otherwise("ingest")
        )
        decided = facts.withColumn("decision", decision)
        if known is not None:
            decided = staged(spark, decided, place("decisions"), mode)
        headers = headers_of(decided.filter("decision = 'ingest'")).withColumnRenamed("header", "_header")
        asked = (F.col("decision") == "ingest") & F.col("header").eqNullSafe(F.col("_header"))
        decided = decided.join(headers, asked, "left").drop("_header")
        opened = decided.select(
            "path", "size_bytes", "modified", "sha256",
            F.when(F.col("reason").isNotNull(), "bad_header").otherwise(F.col("decision")).alias("decision"),
            F.coalesce("reason", "error").alias("reason"),
        )
        report = opened if report is None else report.unionByName(opened)
        raw = read_csv_files(spark, folder, decided.filter("decision = 'ingest' AND reason IS NULL"), n_unknown)
    checked = checked_rows(raw, as_of).withColumn("is_valid", F.size("errors") == 0)
    checked = staged(spark, checked, place("checked"), mode, by=("is_valid",))
    # extremes of the tickers and of the dates: two values each, whatever the size of a file
    per_file = checked.groupBy("_path").agg(
        F.min("ticker").alias("_low"), F.max("ticker").alias("_high"),
        F.min(F.when(F.col("is_valid"), F.col("date"))).alias("_from"), F.max(F.when(F.col("is_valid"), F.col("date"))).alias("_to"),
    )
    mixed = F.coalesce(F.col("_low") != F.col("_high"), F.lit(False))
    per_file = staged(spark, per_file.withColumn("_mixed", mixed), place("extremes"), mode)
    low, high = per_file.filter("NOT _mixed").agg(F.min("_from"), F.max("_to")).first()
    single = checked.filter("is_valid").join(per_file.filter("_mixed").select("_path"), "_path", "left_anti")
    rows = last_input_rows(finished_rows(single, INPUT_ORDER))
    version, counts = apply_changes(table, rows, place("applied"), source, batch_id, mode, ("_path",), (low, high))
    several = per_file.filter("_mixed").select(F.col("_path").alias("path"), F.lit(True).alias("_several"))
    report = report.join(several, "path", "left").withColumn("decision", F.when(F.col("_several"), "several_tickers").otherwise(F.col("decision")))
    taken = checked.join(per_file.filter("_mixed").select("_path"), "_path", "left_anti")
    counted = report.drop("_several").join(file_counts(taken, counts), "path", "left").na.fill(0)
    counted = staged(spark, counted, place("files"), mode)
    if isinstance(processed, ProcessedFiles):
        processed.record(run_id, processed_entries(counted, as_of))
    return IngestResult(version, counted)


def ingest_csv_folder(
    spark: SparkSession,
    folder: str,
    table: YearTable,
    processed: DataFrame | ProcessedFiles,
    work: str,
    as_of: datetime,
    ttl_seconds: float | None = None,
) -> IngestResult:
    """Ingest the CSV files of a folder: file cache, sidecars and headers first, then diff and upsert.

    The report has, per file, ``path, size_bytes, modified, sha256, decision, reason`` and the counts of :func:`file_counts`. Decisions:
    ``ingest``, ``cached``, and for refused files ``bad_checksum``, ``bad_header``, ``several_tickers`` and ``unreadable``. A
    :class:`ProcessedFiles` takes the files that were ingested, so that the next run over the folder opens none of them; a plain frame
    ``path, sha256, processed_at`` is only read. Invalid rows and malformed lines stay below ``work``
    (:func:`quarantined_file_rows`), which must be new.
    """
    listing = listed_files(spark, folder, "*.csv")
    return ingest_files(spark, folder, listing, table, processed, lambda kind: f"{work}/{kind}", as_of, work, ttl_seconds)


def quarantined_file_rows(spark: SparkSession, work: str) -> DataFrame:
    """The invalid rows of a file ingest, malformed lines among them, with their file and their errors."""
    return spark.read.parquet(f"{work}/checked").filter("NOT is_valid").drop("is_valid")


def pull_sample(
    feed: DataFrame,
    source: str | Column,
    as_of: date,
    days: int = 5,
    start: date | str | None = None,
    end: date | str | None = None,
    fetched_at: datetime | Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The raw rows of a provider feed in a short range, and the same rows in canonical form; nothing is stored.

    The range is the last ``days`` days (one at least) up to ``as_of`` unless ``start`` or ``end`` is given; both ends belong to it. Rows whose
    date does not parse are in neither.
    """
    label = find_column(feed.columns, ("date",))
    if label is None:
        raise MappingError("no date column")
    text = quoted(label).cast("string")
    day = F.coalesce(feed_date(text), lenient_date(text))
    if start is None and end is None:
        start, end = as_of - timedelta(days=max(1, days)), as_of
    raw = feed
    if start is not None:
        raw = raw.filter(day >= F.lit(start).cast("date"))
    if end is not None:
        raw = raw.filter(day <= F.lit(end).cast("date"))
    return raw, to_canonical(raw, source, fetched_at=fetched_at)


def save_sample(raw: DataFrame, canonical: DataFrame, folder: str) -> None:
    """Both sides of a sample as CSV below ``raw`` and ``canonical`` of a new folder."""
    raw.write.options(**AS_GIVEN).csv(f"{folder}/raw", header=True)
    canonical.write.options(dateFormat="yyyy-MM-dd", **AS_GIVEN).csv(f"{folder}/canonical", header=True)


def processed_entries(report: DataFrame, as_of: datetime) -> DataFrame:
    """File-cache entries for the files of a report that are done: ingested, or known by their hash."""
    done = report.filter("decision IN ('ingest', 'cached')")
    return done.select("path", "size_bytes", "modified", "sha256", F.lit(as_of.isoformat()).alias("processed_at"))
