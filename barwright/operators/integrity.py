"""Manifests, sidecars and restore verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions.paths import plain_path
from barwright.schema import Field
from barwright.sources.files import facts_of_listed, listed_files
from barwright.sources.prices import headers_of, read_csv_files


def compare_manifests(expected: DataFrame, current: DataFrame) -> DataFrame:
    """``path, status`` for files that are changed, missing or unexpected."""
    e = expected.select("path", F.col("sha256").alias("_expected"), F.lit(True).alias("_in_expected"))
    c = current.select("path", F.col("sha256").alias("_current"), F.lit(True).alias("_in_current"))
    status = (
        F.when(F.col("_in_current").isNull(), "missing")
        .when(F.col("_in_expected").isNull(), "unexpected")
        .when(~F.col("_expected").eqNullSafe(F.col("_current")), "changed")
    )
    return (
        e.join(c, "path", "full_outer")
        .select("path", status.alias("status"), F.col("_expected").alias("expected"), F.col("_current").alias("current"))
        .filter("status IS NOT NULL")
    )


def sidecar_status() -> Column:
    """What a file's ``sha256`` is beside the hash that its sidecar ``expected``: ``ok``, ``mismatch``, or ``no_sidecar``."""
    return (
        F.when(F.col("expected").isNull(), "no_sidecar")
        .when(F.col("expected") == F.lower("sha256"), "ok")
        .otherwise("mismatch")
    )


def verify_sidecars(hashes: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Per data file: ``ok``, ``mismatch``, or ``no_sidecar`` when it has none."""
    data = hashes.filter(~F.col("path").endswith(".checksum"))
    return data.join(sidecars, "path", "left").select("path", "sha256", "expected", sidecar_status().alias("status"))


def verify_catalog(catalog: DataFrame, hashes: DataFrame) -> DataFrame:
    """Live catalog rows that have a path and a checksum, compared with the files' hashes."""
    live = catalog.filter(~F.coalesce("archived", F.lit(False)))
    checked = live.filter(
        (F.coalesce("snapshot_path", F.lit("")) != "") & (F.coalesce("checksum", F.lit("")) != "")
    )
    found = hashes.select(F.col("path").alias("snapshot_path"), F.col("sha256").alias("computed"))
    status = (
        F.when(F.col("computed").isNull(), "missing")
        .when(F.col("computed") == F.col("checksum"), "pass")
        .otherwise("mismatch")
    )
    return checked.join(found, "snapshot_path", "left").select(
        "id", "ticker", "snapshot_path", "checksum", "computed", status.alias("status")
    )


def integrity_totals(verified: DataFrame) -> DataFrame:
    """Total, passed, failed and missing; missing files also count as failed."""
    return verified.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") != "pass").alias("failed"),
        F.count_if(F.col("status") == "missing").alias("missing"),
    )


# The columns a restorable snapshot must have.
RESTORE_COLUMNS = ("ticker", "date", "open", "high", "low", "close", "volume", "adj_close")


def _present(columns: Column) -> Column:
    """Whether an array of column names can be restored; a missing adjusted close is taken from the close."""
    given = F.when(F.array_contains(columns, "close"), F.array_append(columns, F.lit("adj_close"))).otherwise(columns)
    return F.size(F.array_except(F.array(*(F.lit(c) for c in RESTORE_COLUMNS)), given)) == 0


def restore_checks(rows: DataFrame, metadata: DataFrame, hashes: DataFrame, file: str = "file") -> DataFrame:
    """Verdict per snapshot file: PASS, WARN (only the checksum differs) or FAIL, with the four checks.

    ``rows`` are the rows of all files with the file name, ``metadata`` is ``file, expected_rows, checksum`` of the
    catalog and ``hashes`` is ``file, sha256``, with ``columns``, the names in each file's own header, where the files were read
    by these; otherwise the columns are those of ``rows``. The row count passes when every (ticker, date) of the file could
    be restored once. Counts form per key first, so neither a large file nor a repeated key is gathered.
    """
    if "columns" not in hashes.columns:
        hashes = hashes.withColumn("columns", F.array(*(F.lit(c) for c in rows.columns)))
    per_key = rows.groupBy(file, "ticker", "date").agg(F.count("*").alias("_n"))
    null_key = F.col("ticker").isNull() | F.col("date").isNull()
    per_file = per_key.groupBy(file).agg(
        F.sum("_n").alias("rows_restored"),
        F.count_if(~null_key).alias("_keys"),
        F.coalesce(F.sum(F.when(null_key, F.col("_n"))), F.lit(0)).alias("_null_rows"),
        F.min(F.struct("date", "ticker")).alias("_first"),
        F.max(F.struct("date", "ticker")).alias("_last"),
    )
    joined = (
        hashes.select(file, "sha256", F.coalesce(_present(F.col("columns")), F.lit(False)).alias("_present"))
        .join(per_file, file, "left")
        .join(metadata.select(file, "checksum", "expected_rows"), file, "left")
    )
    restored = F.coalesce("rows_restored", F.lit(0))
    complete = (F.col("_keys") == F.col("rows_restored")) & (F.col("_null_rows") == 0)
    counted = complete & (F.col("expected_rows").isNull() | (F.col("expected_rows") == restored))
    ends = (restored > 0) & F.col("_first.date").isNotNull() & F.col("_last.date").isNotNull()

    def verdict(ok: Column) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)) & F.col("_present"), "pass").otherwise("fail")

    known = F.coalesce("checksum", F.lit("")) != ""
    match = F.when(known & (F.col("checksum") == F.col("sha256")), "pass").otherwise("fail")
    checked = joined.select(
        file,
        restored.alias("rows_restored"),
        F.when(F.col("_present"), "pass").otherwise("fail").alias("columns_present"),
        verdict(counted).alias("row_count"),
        verdict(ends).alias("sample_row_check"),
        match.alias("checksum_match"),
        known.alias("_known"),
    )
    sound = (
        F.col("_known")
        & (F.col("columns_present") == "pass")
        & (F.col("row_count") == "pass")
        & (F.col("sample_row_check") == "pass")
    )
    overall = F.when(~sound, "FAIL").when(F.col("checksum_match") == "fail", "WARN").otherwise("PASS")
    code = F.when(~sound, 2).when(F.col("checksum_match") == "fail", 1).otherwise(0)
    return checked.select("*", overall.alias("overall"), code.alias("exit_code")).drop("_known")


# Reasons why a file is not restorable, beside its four checks.
MISSING_FILE, UNREADABLE = "file is missing", "file cannot be read"


def verify_restores(spark: SparkSession, catalog: DataFrame, root: str, folder: str) -> DataFrame:
    """Verdict per catalog row ``id, snapshot_path, rows, checksum`` from its file below ``root``, restored row by row.

    ``id, path, rows_restored``, the four checks of :func:`restore_checks`, ``overall``, ``exit_code`` and ``reason``. Each file is
    hashed with its header, then parsed by that header, so that the columns of one file say nothing about another. Lines that do
    not fit their header cannot be restored. A file that is missing, or cannot be read, fails. ``folder`` must be new; it keeps
    the facts of the files.
    """
    wanted = catalog.filter("snapshot_path IS NOT NULL").select(
        "id", plain_path(F.col("snapshot_path")).alias("path"), F.col("rows").alias("expected_rows"), "checksum"
    )
    wanted.write.parquet(f"{folder}/wanted")  # what the catalog takes is done once
    wanted = spark.read.schema(wanted.schema).parquet(f"{folder}/wanted")
    listing = listed_files(spark, root).join(wanted.select("path"), "path", "left_semi")
    facts, count = facts_of_listed(spark, root, listing)
    facts.write.parquet(f"{folder}/facts")
    facts = spark.read.schema(facts.schema).parquet(f"{folder}/facts")
    headers = headers_of(facts.filter("error IS NULL"), needed=()).withColumnRenamed("header", "_header")
    read = facts.filter("error IS NULL").join(headers, F.col("header").eqNullSafe(F.col("_header")), "left").drop("_header")
    fields = tuple(Field(c, "string", True) for c in RESTORE_COLUMNS)
    rows = read_csv_files(spark, root, read.filter("reason IS NULL"), count, fields, needed=()).withColumnRenamed("_path", "path")
    # a line that does not fit has no key that could be restored
    rows = rows.withColumns({c: F.when(F.col("_corrupt").isNull(), F.col(c)) for c in ("ticker", "date")})
    columns = F.transform(F.split("header", ","), lambda c: F.lower(F.trim(F.regexp_replace(c, '"', ""))))
    hashes = facts.select("path", "sha256", columns.alias("columns"))
    checks = restore_checks(rows, wanted, hashes, "path")
    strange = read.filter("reason IS NOT NULL").select("path", F.col("reason").alias("_reason"))
    found = wanted.select("id", "path").join(checks, "path", "left").join(strange, "path", "left")
    found = found.join(facts.select("path", "error"), "path", "left")
    fallen = {c: F.coalesce(c, F.lit("fail")) for c in ("columns_present", "row_count", "sample_row_check", "checksum_match")}
    reason = (
        F.when(F.col("columns_present").isNull(), MISSING_FILE)
        .when(F.col("error").isNotNull(), UNREADABLE)
        .otherwise(F.col("_reason"))
    )
    return found.select(
        "id", "path", F.coalesce("rows_restored", F.lit(0)).alias("rows_restored"), *(v.alias(c) for c, v in fallen.items()),
        F.coalesce("overall", F.lit("FAIL")).alias("overall"), F.coalesce("exit_code", F.lit(2)).alias("exit_code"), reason.alias("reason"),
    )


def end_rows_exist(rows: DataFrame, store: DataFrame, file: str = "file") -> DataFrame:
    """Per file: whether the keys of its first and last row exist in the store."""
    ends = rows.groupBy(file).agg(
        F.min(F.struct("date", "ticker")).alias("first"), F.max(F.struct("date", "ticker")).alias("last")
    )
    keys = ends.select(file, F.explode(F.array_distinct(F.array("first", "last"))).alias("_key")).select(
        file, "_key.date", "_key.ticker"
    )
    known = store.select("ticker", "date").distinct().withColumn("_known", F.lit(True))
    return (
        keys.join(known, ["ticker", "date"], "left")
        .groupBy(file)
        .agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("ends_exist"))
    )
