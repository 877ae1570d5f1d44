"""Catalog queries, integrity checks, retention, and files written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions.names import basename
from barwright.operators.catalog import (
    basename_collisions,
    by_ids,
    by_paths,
    distinct_tickers,
    list_snapshots,
    prune_list,
    purge_candidates,
    resolve_tickers,
)
from barwright.operators.integrity import (
    RESTORE_COLUMNS,
    compare_manifests,
    end_rows_exist,
    integrity_totals,
    restore_checks,
    verify_catalog,
    verify_restores,
    verify_sidecars,
)
from barwright.operators.audit import AuditLog, feed_problem_events, invalid_row_events, job_events, save_raw
from barwright.operators.diff import concat
from barwright.operators.quality import annotate, invalid_rows, validation_events
from barwright.operators.retention import (
    apply_repairs,
    archive,
    archive_totals,
    delete,
    mark_archived,
    prune,
    purge,
    repair_plan,
)
from barwright.operators.stats import rows_summary
from barwright.plans import views
from barwright.plans.queries_quality import ERRORS_SQL
from barwright.plans.registry import query
from barwright.schema import JOB_LOG, struct_type
from barwright.session import scratch_dir
from barwright.sources.files import (
    copy_files,
    file_facts,
    file_hashes,
    listed_files,
    load_manifest,
    manifest_lines,
    read_manifest,
    relative_to,
    write_csv_folders,
    write_manifest,
    write_sidecars,
)
from barwright.sources.prices import (
    export_csv,
    export_json,
    raw_records,
    read_price_csv,
    read_snapshot,
    write_raw_feed,
    write_snapshot,
)

BAR_COLUMNS = ("ticker", "date", "open", "high", "low", "close", "volume", "source")
AS_OF_SQL = f"TIMESTAMP '{views.AS_OF}'"
PURGE_SQL = f"""NOT archived AND snapshot_path IS NOT NULL AND created_at < {AS_OF_SQL} - INTERVAL 365 DAY"""


def day(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


@query("distinct_tickers", "SELECT DISTINCT ticker FROM bars", ("bars",))
def query_distinct_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_tickers(views.bars(spark, sf_dir))


@query(
    "live_snapshots",
    """SELECT id, ticker, strftime(created_at, '%Y-%m-%d') AS created_at, payload, rows, checksum, size_bytes FROM catalog
      WHERE NOT archived""",
    ("catalog",),
)
def live_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = list_snapshots(views.catalog(spark, sf_dir))
    return day(live.select("id", "ticker", "created_at", "payload", "rows", "checksum", "size_bytes"), "created_at")


@query("archived_snapshots", "SELECT id, ticker, rows FROM catalog WHERE archived", ("catalog",))
def archived_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_snapshots(views.catalog(spark, sf_dir), archived=True).select("id", "ticker", "rows")


@query(
    "snapshots_by_id",
    """SELECT id, ticker, rows FROM catalog WHERE id IN (SELECT 'snap-' || l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    ("catalog",),
)
def snapshots_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = views.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    ids = wanted.selectExpr("concat('snap-', l_orderkey) AS id")
    return by_ids(views.catalog(spark, sf_dir), ids).select("id", "ticker", "rows")


@query(
    "snapshots_by_path",
    """SELECT path, id, ticker FROM (SELECT f.path, c.id, c.ticker, row_number() OVER (PARTITION BY f.path
        ORDER BY c.kept DESC, c.created_at DESC, c.id DESC) AS rn
      FROM files f JOIN (SELECT *, CASE WHEN starts_with(snapshot_path, '/tmp/') AND rows % 2 = 0
          THEN split_part(snapshot_path, '/', 3) ELSE snapshot_path END AS held,
          CASE WHEN starts_with(snapshot_path, '/tmp/') AND rows % 2 <> 0 THEN 0 ELSE 1 END AS kept FROM catalog) c
        ON c.held = f.path OR (starts_with(f.path, '/tmp/') AND c.held = split_part(f.path, '/', 3))) WHERE rn = 1""",
    ("files",),
)
def snapshots_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.when(
        F.col("snapshot_path").startswith("/tmp/") & (F.col("rows") % 2 == 0), basename(F.col("snapshot_path"))
    ).otherwise(F.col("snapshot_path"))
    catalog = views.catalog(spark, sf_dir).withColumn("snapshot_path", held)
    return by_paths(views.snapshot_files(spark, sf_dir).select("path"), catalog).select("path", "id", "ticker")


@query(
    "resolved_tickers",
    """SELECT r.requested, CASE WHEN n % 3 = 0 THEN t.base WHEN n % 3 = 1 THEN t.base || '.SA' END AS ticker
      FROM (SELECT DISTINCT ticker AS base, CAST(substr(ticker, 2) AS BIGINT) AS n, ' ' || lower(ticker) || '.sa' AS requested
        FROM bars) r JOIN (SELECT DISTINCT ticker AS base FROM bars) t ON t.base = r.base""",
    ("bars",),
)
def resolved_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = views.bars(spark, sf_dir).withColumn("n", F.expr("cast(substr(ticker, 2) as bigint) % 3"))
    requested = prices.select(F.concat(F.lit(" "), F.lower("ticker"), F.lit(".sa")).alias("requested"))
    # a third of the tickers is held under both forms, a third with the suffix only, a third under another name
    held = prices.select(
        F.explode(
            F.when(F.col("n") == 0, F.array("ticker", F.concat("ticker", F.lit(".SA"))))
            .when(F.col("n") == 1, F.array(F.concat("ticker", F.lit(".SA"))))
            .otherwise(F.array(F.concat(F.lit("X"), "ticker")))
        ).alias("ticker")
    )
    return resolve_tickers(requested, held)


@query(
    "files_to_prune",
    r"""SELECT name, ticker FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY stamp DESC, name) AS rn FROM (
      SELECT name, regexp_extract(name, '^([A-Z0-9]+(\.[A-Z0-9]+)?)-', 1) AS ticker,
        regexp_extract(name, '-(\d{8}T\d{6})', 1) AS stamp
      FROM (SELECT parse_filename(snapshot_path) AS name FROM catalog WHERE snapshot_path IS NOT NULL)
      WHERE regexp_matches(name, '^[A-Z0-9]+(\.[A-Z0-9]+)?-\d{8}T\d{6}Z?(-[^.]+)?\.csv$'))) WHERE rn > 2""",
    ("catalog",),
)
def files_to_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.catalog(spark, sf_dir).filter("snapshot_path IS NOT NULL")
    return prune_list(files.select(basename(F.col("snapshot_path")).alias("name")), keep=2).select("name", "ticker")


@query(
    "pruned_snapshots",
    """SELECT ticker, 3 AS removed, '20240105T000000Z,20240106T000000Z' AS kept, 2 AS sidecars, 0 AS again FROM (SELECT DISTINCT ticker FROM stored)""",
    ("stored",),
)
def pruned_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five snapshot files a ticker, one of them named by no calendar time; the two newest stay, and a second run removes nothing."""
    folder = scratch_dir(spark, "prune")
    write_snapshot(views.stored(spark, sf_dir), f"{folder}/first", rows_per_file=0)
    ticker = F.regexp_extract("path", "_ticker=([^/]+)/", 1)
    source = listed_files(spark, f"{folder}/first", "*.csv").groupBy(ticker.alias("ticker")).agg(F.min("path").alias("path"))
    stamps = F.array(*(F.lit(s) for s in ("20240104T000000Z", "20240106T000000Z", "20240103T000000Z-late", "20249999T000000Z", "20240105T000000Z")))
    target = F.concat(F.lit(f"{folder}/snapshots/"), "ticker", F.lit("-"), F.col("stamp"), F.lit(".csv"))
    plan = source.withColumn("stamp", F.explode(stamps)).select("path", target.alias("target"))
    copy_files(plan).write.parquet(f"{folder}/copied")
    write_sidecars(file_hashes(spark, f"{folder}/snapshots", "*.csv")).write.parquet(f"{folder}/sidecars")
    outcomes = [prune(spark, f"{folder}/snapshots", 2, f"{folder}/report") for _ in range(2)]
    removed, again = (o.groupBy("ticker").agg(F.count_if("deleted").cast("int").alias(n)) for o, n in zip(outcomes, ("removed", "again"), strict=True))
    left = listed_files(spark, f"{folder}/snapshots").select(basename(F.col("path")).alias("name"))
    named = F.substring_index("name", "-", 1).alias("ticker")
    data = F.when(F.col("name").endswith(".csv"), F.regexp_extract("name", "-(.*)[.]csv$", 1))
    left = left.groupBy(named).agg(
        F.array_join(F.array_sort(F.collect_list(data)), ",").alias("kept"), F.count_if(F.col("name").endswith(".checksum")).cast("int").alias("sidecars")
    )
    return removed.join(left, "ticker").join(again, "ticker", "left").na.fill(0).select("ticker", "removed", "kept", "sidecars", "again")


@query(
    "purge_candidates",
    f"""SELECT id, snapshot_path AS path, ticker, strftime(created_at, '%Y-%m-%d') AS created_at, size_bytes, checksum
      FROM catalog WHERE {PURGE_SQL}""",
    ("catalog",),
)
def query_purge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = purge(spark, views.catalog(spark, sf_dir), 365, views.AS_OF)
    return day(plan, "created_at")


@query(
    "marked_archived",
    f"""SELECT id, archived OR ({PURGE_SQL}) AS archived, strftime(CASE WHEN {PURGE_SQL} THEN {AS_OF_SQL} ELSE archived_at END,
      '%Y-%m-%d') AS archived_at FROM catalog""".replace(f"OR ({PURGE_SQL})", f"OR coalesce({PURGE_SQL}, false)"),
    ("catalog",),
)
def marked_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = views.catalog(spark, sf_dir)
    marked = mark_archived(catalog, purge_candidates(catalog, 365, views.AS_OF), views.AS_OF)
    return day(marked.select("id", "archived", "archived_at"), "archived_at")


@query(
    "catalog_integrity",
    """SELECT c.id, c.ticker, CASE WHEN f.path IS NULL THEN 'missing' WHEN f.sha256 = c.checksum THEN 'pass' ELSE 'mismatch' END
      AS status FROM catalog c LEFT JOIN files f ON f.path = c.snapshot_path
      WHERE NOT c.archived AND c.snapshot_path IS NOT NULL AND c.checksum IS NOT NULL""",
    ("files",),
)
def catalog_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    verified = verify_catalog(views.catalog(spark, sf_dir), views.snapshot_files(spark, sf_dir))
    return verified.select("id", "ticker", "status")


@query(
    "integrity_totals",
    """SELECT count(*) AS total, count(*) FILTER (WHERE f.sha256 = c.checksum) AS passed,
      count(*) FILTER (WHERE f.path IS NULL OR f.sha256 <> c.checksum) AS failed, count(*) FILTER (WHERE f.path IS NULL) AS missing
      FROM catalog c LEFT JOIN files f ON f.path = c.snapshot_path
      WHERE NOT c.archived AND c.snapshot_path IS NOT NULL AND c.checksum IS NOT NULL""",
    ("files",),
)
def query_integrity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity_totals(verify_catalog(views.catalog(spark, sf_dir), views.snapshot_files(spark, sf_dir)))


REPAIR_SQL = """SELECT c.id, c.ticker, c.snapshot_path AS old_path,
    '/data/snapshots/' || parse_filename(c.snapshot_path) AS candidate_path,
    CASE WHEN f.sha256 = c.checksum THEN 'update_path' ELSE 'archive' END AS action,
    CASE WHEN f.sha256 = c.checksum THEN 'matching file found' WHEN f.sha256 IS NOT NULL THEN 'file found, checksum differs'
      ELSE 'file missing' END AS reason
  FROM catalog c LEFT JOIN files f ON f.path = c.snapshot_path WHERE starts_with(c.snapshot_path, '/tmp/')"""


def orphan_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.snapshot_files(spark, sf_dir)
    held = found.withColumn("path", F.regexp_replace("path", "^/tmp/", "/data/snapshots/"))
    return repair_plan(views.catalog(spark, sf_dir), held, "/data/snapshots")


@query("repair_plan", REPAIR_SQL, ("files",))
def query_repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_plan(spark, sf_dir).drop("checksum")


@query(
    "repaired_catalog",
    f"""SELECT c.id, CASE WHEN r.action = 'update_path' THEN r.candidate_path ELSE c.snapshot_path END AS snapshot_path,
      c.archived OR coalesce(r.action = 'archive', false) AS archived FROM catalog c LEFT JOIN ({REPAIR_SQL}) r ON r.id = c.id""",
    ("files",),
)
def repaired_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = apply_repairs(views.catalog(spark, sf_dir), orphan_plan(spark, sf_dir), views.AS_OF)
    return repaired.select("id", "snapshot_path", "archived")


@query(
    "basename_collisions",
    """SELECT key, path FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM (
      SELECT ticker || '.csv' AS key, '/in/' || id || '/' || ticker || '.csv' AS path FROM catalog)) WHERE n > 1""",
    ("catalog",),
)
def query_basename_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = views.catalog(spark, sf_dir).select(
        F.concat(F.lit("/in/"), "id", F.lit("/"), "ticker", F.lit(".csv")).alias("path")
    )
    return basename_collisions(paths)


@query(
    "manifest_differences",
    """SELECT coalesce(e.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'unexpected'
      ELSE 'changed' END AS status, e.sha256 AS expected, c.sha256 AS current
      FROM expected_files e FULL OUTER JOIN current_files c ON e.path = c.path
      WHERE e.path IS NULL OR c.path IS NULL OR e.sha256 <> c.sha256""",
    ("expected_files", "current_files"),
)
def manifest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_manifests(views.manifest(spark, sf_dir, False), views.manifest(spark, sf_dir, True))


@query("manifest_round_trip", "SELECT path, sha256 FROM current_files", ("current_files",))
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "manifest") + "/m"
    write_manifest(views.manifest(spark, sf_dir, True), folder, views.FETCHED.isoformat())
    return load_manifest(spark, folder)


def document_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Files per document source, its documents with their whole texts as JSON lines."""
    line = F.to_json(F.struct("doc_id", "text")).alias("value")
    docs = views.table(spark, sf_dir, "documents").select("source", line)
    docs.hint("rebalance", F.col("source")).sortWithinPartitions("value").write.partitionBy("source").text(folder)


@query(
    "sidecar_status",
    """SELECT DISTINCT source, CASE CAST(substr(source, 4) AS BIGINT) % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'mismatch' ELSE 'no_sidecar' END
      AS status FROM documents""",
)
def sidecar_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the documents whose sidecar fits, does not fit, or is missing, by the number of the source."""
    folder = scratch_dir(spark, "sidecars") + "/f"
    document_files(spark, sf_dir, folder)
    hashes = relative_to(file_hashes(spark, folder, "*.txt"), folder)
    source = F.regexp_extract("path", "source=([^/]+)/", 1)
    kind = F.substring(source, 4, 10).cast("bigint") % 3
    sidecars = hashes.filter(kind < 2).select(
        "path", F.when(kind == 0, F.col("sha256")).otherwise(F.sha2("sha256", 256)).alias("expected")
    )
    return verify_sidecars(hashes, sidecars).select(source.alias("source"), "status").distinct()


@query(
    "file_line_totals",
    "SELECT count(*) AS lines, count(DISTINCT source) AS sources FROM documents",
)
def file_line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash every written file, then check that hashing saw all bytes: the lines of all files are the documents."""
    folder = scratch_dir(spark, "hashes") + "/f"
    document_files(spark, sf_dir, folder)
    hashes = relative_to(file_hashes(spark, folder, "*.txt"), folder)
    source = F.regexp_extract("path", "source=([^/]+)/", 1)
    listed = read_manifest(manifest_lines(hashes, "now")).select(source.alias("source"))
    lines = spark.read.schema("value string").text(f"{folder}/source=*")
    return lines.agg(F.count("*").alias("lines")).select(
        "lines", listed.agg(F.count_distinct("source")).scalar().alias("sources")
    )


@query("snapshot_round_trip", f"SELECT {', '.join(BAR_COLUMNS)} FROM stored", ("stored",))
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "snapshot") + "/s"
    write_snapshot(views.stored(spark, sf_dir), folder)
    return read_snapshot(spark, folder).select(*BAR_COLUMNS)


@query(
    "snapshot_catalog_rows",
    "SELECT ticker, count(*) AS rows, strftime(min(date), '%Y-%m-%d') AS min_date, strftime(max(date), '%Y-%m-%d') AS max_date FROM stored GROUP BY ticker",
    ("stored",),
)
def snapshot_catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "snapshot") + "/s"
    write_snapshot(views.stored(spark, sf_dir), folder)
    summary = rows_summary(read_snapshot(spark, folder))
    files = file_hashes(spark, folder, "*.csv").withColumn("ticker", F.regexp_extract("path", "_ticker=([^/]+)/", 1))
    sizes = files.groupBy("ticker").agg(F.sum("size_bytes").alias("size_bytes"))
    return summary.join(sizes.filter("size_bytes > 0"), "ticker").select(
        "ticker", F.col("rows_summary.count").alias("rows"), "rows_summary.min_date", "rows_summary.max_date"
    )


@query("typed_csv_rows", "SELECT ticker, date, open, high, low, close, volume, source FROM incoming", ("incoming",))
def typed_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "csv") + "/c"
    export_csv(views.incoming(spark, sf_dir), folder)
    return read_price_csv(spark, folder, typed=True).select(*BAR_COLUMNS)


@query(
    "exported_range",
    """SELECT ticker, date, open, high, low, close, volume, source FROM stored
      WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""",
    ("stored",),
)
def exported_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "export") + "/c"
    export_csv(views.stored(spark, sf_dir), folder, start="1996-01-01", end="1996-12-31")
    return read_price_csv(spark, folder, typed=True).select(*BAR_COLUMNS)


@query(
    "exported_json",
    """SELECT ticker, count(*) AS rows, CAST(sum(CAST(round(close * 10000) AS BIGINT)) AS BIGINT) AS close_total,
      strftime(min(date), '%Y-%m-%d') AS first_date FROM stored GROUP BY ticker""",
    ("stored",),
)
def exported_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "json") + "/j"
    rows = views.stored(spark, sf_dir)
    checksums = rows.select("ticker").distinct().withColumn("checksum", F.sha2("ticker", 256))
    export_json(rows, checksums, folder)
    schema = "ticker string, checksum string, rows long, data array<struct<date:string,close:double>>"
    total = F.aggregate("data", F.lit(0).cast("long"), lambda t, d: t + F.round(d["close"] * 10000).cast("long"))
    return spark.read.schema(schema).json(folder).select(
        "ticker", "rows", total.alias("close_total"), F.col("data")[0]["date"].alias("first_date")
    )


@query(
    "raw_feed_round_trip",
    """SELECT provider, feed_row, date AS "Date", open AS "Open", close AS "Close", volume AS "Volume" FROM raw_quotes""",
    ("raw_quotes",),
)
def raw_feed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "raw") + "/r"
    feed = views.raw_quotes(spark, sf_dir).withColumn("seq", F.col("seq").cast("string"))
    write_raw_feed(feed, folder, "20240131T000000Z", by=("provider",))
    schema = ", ".join(f"`{c}` string" for c in feed.columns if c != "provider")
    stored = spark.read.schema(schema).csv(f"{folder}/provider=*/ingest_ts=*", header=True)
    provider = F.regexp_extract(F.col("_metadata.file_path"), "provider=([^/]+)/", 1)
    return stored.select(provider.alias("provider"), "feed_row", "Date", "Open", "Close", "Volume")


@query(
    "raw_records",
    """SELECT provider, count(*) AS rows, 'job-1' AS job_id, 'success' AS status FROM raw_quotes GROUP BY provider""",
    ("raw_quotes",),
)
def query_raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = raw_records(views.raw_quotes(spark, sf_dir), "job-1", views.FETCHED, by=("provider",))
    return records.select("provider", "rows", "job_id", "status")


@query(
    "validation_event_log",
    """SELECT provider, count(*) AS invalid_rows FROM typed WHERE (raw_date IS NOT NULL AND date IS NULL) OR (raw_open IS NOT NULL
      AND open IS NULL) OR (raw_volume IS NOT NULL AND volume IS NULL) OR source IS NULL OR high < low GROUP BY provider""",
    ("typed",),
)
def validation_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "events") + "/e"
    bad = invalid_rows(annotate(views.quotes(spark, sf_dir)))
    validation_events(bad, ("provider",), ("feed_row",), details_per_event=100).write.mode("append").json(folder)
    schema = "provider string, part long, error_details array<struct<feed_row:string>>"
    events = spark.read.schema(schema).json(folder)
    return events.groupBy("provider").agg(F.sum(F.size("error_details")).alias("invalid_rows"))


AUDIT_SQL = """SELECT 'raw_pull' AS kind, 'pull-1' AS job_id, provider, NULL AS ticker, NULL AS reason, count(*) AS rows, 0 AS invalid_count,
    0 AS errors, 'success' AS status, true AS named, true AS checked FROM raw_quotes GROUP BY provider
  UNION ALL SELECT 'invalid_rows', 'check-1', provider, NULL, reason_code, 0, 0, count(*), 'error', true, true FROM ({errors}) GROUP BY provider, reason_code
  UNION ALL SELECT 'invalid_rows', 'check-1', provider, NULL, NULL, 0, count(DISTINCT feed_row), 0, 'error', true, true FROM ({errors}) GROUP BY provider
  UNION ALL SELECT 'feed_problem', 'feed-1', 'gamma', 'S0000001', 'ADAPTER_VALIDATION', 0, 0, 2, 'error', false, true
  UNION ALL SELECT 'job', job_id, source, ticker, error_message, rows, 0, 0, status, false, true FROM job_log"""


@query("audit_events", AUDIT_SQL.format(errors=ERRORS_SQL), ("typed", "raw_quotes", "job_log"))
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pulls, invalid rows, a refused feed and jobs in one log; every job is recorded twice and is there once.

    ``named`` says whether the event names its file, ``checked`` whether that file's bytes have the event's hash.
    """
    folder = scratch_dir(spark, "audit")
    log = AuditLog(spark, f"{folder}/log")
    for _ in range(2):
        raw = save_raw(spark, views.raw_quotes(spark, sf_dir), f"{folder}/raw", "20240131T000000Z", "pull-1", views.FETCHED, by=("provider",))
        log.record("pull-1", raw)
        file = F.concat(F.lit(f"{folder}/raw/provider="), "provider")
        quotes = annotate(views.quotes(spark, sf_dir))
        log.record("check-1", invalid_row_events(quotes, "check-1", views.FETCHED, "feed_row", file, file, ("provider",), 100))
        refused = views.bars(spark, sf_dir).select("ticker", "open", "high", "low", "close", "volume").limit(0)
        log.record("feed-1", feed_problem_events(spark, refused.withColumn("date", F.lit(1)), "feed-1", views.FETCHED, "gamma", "S0000001"))
        log.record("jobs-1", job_events(views.job_log(spark, sf_dir), views.FETCHED))
    events = log.read()
    now = file_facts(spark, f"{folder}/raw", "*.csv").select(F.col("path").alias("raw_file"), F.col("sha256").alias("now"))
    events = events.join(now, "raw_file", "left").withColumn("checked", F.coalesce(F.col("now") == F.col("file_checksum"), F.lit(True)))
    named = F.coalesce(F.col("raw_file") != "", F.lit(False))
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    shared = ("kind", "job_id", "provider")
    pulls = events.filter("kind = 'raw_pull'").groupBy(*shared, "status").agg(
        F.max("rows").alias("rows"), F.bool_and(named).alias("named"), F.bool_and("checked").alias("checked")
    )  # a large feed has several files
    details = events.filter("kind IN ('invalid_rows', 'feed_problem')").select(*shared, "ticker", "status", named.alias("named"), F.explode("error_details").alias("d"))
    errors = details.groupBy(*shared, "ticker", "status", "named", F.col("d.reason_code").alias("reason")).agg(F.count("*").alias("errors"))
    invalid = events.filter("kind = 'invalid_rows'").groupBy(*shared, "status").agg(F.max("invalid_count").alias("invalid_count"), F.bool_and(named).alias("named"))
    jobs = events.filter("kind = 'job'").select(*shared, "ticker", F.col("error_message").alias("reason"), "rows", "status", named.alias("named"))
    columns = {"ticker": none, "reason": none, "rows": zero, "invalid_count": zero, "errors": zero, "checked": F.lit(True)}
    order = (*shared, "ticker", "reason", "rows", "invalid_count", "errors", "status", "named", "checked")
    return concat(*(
        df.withColumns({c: v for c, v in columns.items() if c not in df.columns}).select(*order) for df in (pulls, errors, invalid, jobs)
    ))


@query(
    "job_log_round_trip",
    """SELECT job_id, ticker, source, status, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, rows, error_message
      FROM job_log""",
    ("job_log",),
)
def job_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "jobs") + "/l"
    views.job_log(spark, sf_dir).write.mode("append").json(folder)
    log = spark.read.schema(struct_type(JOB_LOG)).json(folder)
    return log.select(
        "job_id",
        "ticker",
        "source",
        "status",
        F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
        "rows",
        "error_message",
    )


@query(
    "restore_verdicts",
    """SELECT ticker AS file, count(*) + CASE WHEN n % 5 = 1 THEN 1 ELSE 0 END AS rows_restored,
      CASE WHEN n % 5 = 1 THEN 'fail' ELSE 'pass' END AS row_count,
      CASE WHEN n % 5 IN (2, 3) THEN 'fail' ELSE 'pass' END AS checksum_match,
      CASE WHEN n % 5 IN (1, 3) THEN 'FAIL' WHEN n % 5 = 2 THEN 'WARN' ELSE 'PASS' END AS overall,
      CASE WHEN n % 5 IN (1, 3) THEN 2 WHEN n % 5 = 2 THEN 1 ELSE 0 END AS exit_code
      FROM (SELECT *, CAST(substr(ticker, 2) AS BIGINT) AS n FROM bars) GROUP BY ticker, n""",
    ("bars",),
)
def restore_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.bars(spark, sf_dir).withColumn("n", F.expr("cast(substr(ticker, 2) as bigint) % 5"))
    first = bars.groupBy("ticker").agg(F.min("date").alias("date"))
    repeated = bars.filter("n = 1").join(first, ["ticker", "date"]).select(*bars.columns)  # a key that is there twice
    rows = bars.unionByName(repeated).withColumn("file", F.col("ticker"))
    files = bars.groupBy(F.col("ticker").alias("file"), "n").agg(F.count("*").alias("_rows"))
    hashes = files.select("file", F.sha2("file", 256).alias("sha256"))
    known = F.when(F.col("n") == 2, F.sha2(F.lit("other"), 256)).when(F.col("n") != 3, F.sha2("file", 256))
    expected = F.col("_rows") + (F.col("n") == 1).cast("int")
    metadata = files.select("file", known.alias("checksum"), expected.alias("expected_rows"))
    checks = restore_checks(rows.drop("n"), metadata, hashes)
    return checks.select("file", "rows_restored", "row_count", "checksum_match", "overall", "exit_code")


def damaged_snapshots(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The catalog of snapshot files, and a damaged copy of them below ``copy``: the paths are those of the copy.

    By ticker: a whole copy, a key that is there twice, other bytes for the same rows, a lost column, a lost file.
    """
    kind = F.expr("cast(substr(ticker, 2) as bigint) % 5")
    rows = views.canonical(views.bars(spark, sf_dir)).withColumn("adj_close", F.col("close"))

    def write(df: DataFrame, name: str, columns: tuple[str, ...] = RESTORE_COLUMNS, **options: str) -> None:
        chosen = df.select(F.col("ticker").alias("_t"), *columns)
        write_csv_folders(chosen.repartition("_t"), f"{folder}/{name}", ("_t",), ("date",), mode="append", **options)

    write(rows, "first")
    first = rows.groupBy("ticker").agg(F.min("date").alias("date"))
    again = rows.join(first, ["ticker", "date"]).filter(kind == 1).select(*rows.columns)
    write(rows.filter(kind.isin(0, 1)).unionByName(again), "copy")
    write(rows.filter(kind == 2), "copy", quoteAll="true")
    write(rows.filter(kind == 3), "copy", tuple(c for c in RESTORE_COLUMNS if c != "volume"))
    ticker = F.regexp_extract("path", "_t=([^/]+)/", 1)
    known = file_facts(spark, f"{folder}/first", "*.csv").select(ticker.alias("ticker"), "sha256")
    copies = listed_files(spark, f"{folder}/copy", "*.csv").select(ticker.alias("ticker"), F.col("path").alias("snapshot_path"))
    counts = rows.groupBy("ticker").agg(F.count("*").alias("rows"))
    lost = F.concat(F.lit(f"{folder}/copy/_t="), "ticker", F.lit("/lost.csv"))
    return known.join(copies, "ticker", "left").join(counts, "ticker").select(
        F.concat(F.lit("snap-"), "ticker").alias("id"), F.coalesce("snapshot_path", lost).alias("snapshot_path"),
        (F.col("rows") + (kind == 1).cast("int")).alias("rows"), F.col("sha256").alias("checksum"),
    )


@query(
    "verified_restores",
    """SELECT 'snap-' || ticker AS id, CASE WHEN n = 4 THEN 0 ELSE c + CASE WHEN n = 1 THEN 1 ELSE 0 END END AS rows_restored,
      CASE WHEN n IN (3, 4) THEN 'fail' ELSE 'pass' END AS columns_present, CASE WHEN n IN (1, 3, 4) THEN 'fail' ELSE 'pass' END AS row_count,
      CASE WHEN n IN (3, 4) THEN 'fail' ELSE 'pass' END AS sample_row_check, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS checksum_match,
      CASE WHEN n = 0 THEN 'PASS' WHEN n = 2 THEN 'WARN' ELSE 'FAIL' END AS overall,
      CASE WHEN n = 0 THEN 0 WHEN n = 2 THEN 1 ELSE 2 END AS exit_code, CASE WHEN n = 4 THEN 'file is missing' END AS reason
      FROM (SELECT ticker, CAST(substr(ticker, 2) AS BIGINT) % 5 AS n, count(*) AS c FROM bars GROUP BY ticker)""",
    ("bars",),
)
def verified_restores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot files are written, cataloged, damaged and restored; every verdict comes from the file itself."""
    folder = scratch_dir(spark, "restore")
    catalog = damaged_snapshots(spark, sf_dir, folder)
    return verify_restores(spark, catalog, f"{folder}/copy", f"{folder}/work").drop("path")


@query(
    "end_rows_in_store",
    """SELECT ticker AS file, max(date) < DATE '1999-01-01' AS ends_exist FROM bars GROUP BY ticker""",
    ("bars",),
)
def end_rows_in_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.bars(spark, sf_dir).withColumn("file", F.col("ticker"))
    return end_rows_exist(rows, views.stored(spark, sf_dir))


def snapshot_catalog_on_disk(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Snapshot files of every supplier nation, and a catalog of them: fitting, unknown and wrong checksums, lost files."""
    suppliers = views.table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.concat_ws(",", "s_suppkey", "s_name").alias("value")
    )
    suppliers.repartition("nation").sortWithinPartitions("nation", "value").write.partitionBy("nation").text(folder)
    nation = F.regexp_extract("path", "nation=([^/]+)/", 1).cast("int")
    files = file_hashes(spark, folder, "*.txt").withColumn("n", nation)
    path = F.when(F.col("n") % 5 == 3, F.concat("path", F.lit(".lost"))).otherwise(F.col("path"))
    checksum = F.when(F.col("n") % 5 == 1, F.sha2("sha256", 256)).when(F.col("n") % 5 != 2, F.col("sha256"))
    return files.select(
        F.concat(F.lit("nation-"), "n").alias("id"),
        F.col("n").cast("string").alias("ticker"),
        F.lit("1998-01-01").cast("timestamp").alias("created_at"),
        path.alias("snapshot_path"),
        "size_bytes",
        checksum.alias("checksum"),
        F.lit(False).alias("archived"),
        F.lit(None).cast("timestamp").alias("archived_at"),
    )


ARCHIVE_SQL = """SELECT 'nation-' || s_nationkey AS id, CASE WHEN s_nationkey % 5 IN (1, 3) THEN false
  WHEN s_nationkey % 5 <> 2 THEN true END AS checksum_ok, s_nationkey % 5 <> 3 AS archived
  FROM (SELECT DISTINCT s_nationkey FROM supplier)"""


@query("archived_files", ARCHIVE_SQL)
def archived_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "archive")
    catalog = snapshot_catalog_on_disk(spark, sf_dir, f"{folder}/snapshots")
    status, after = purge(
        spark, catalog, 90, views.AS_OF, dry_run=False, confirm=True, archive_dir=f"{folder}/archive"
    )
    return status.select("id", "checksum_ok").join(after.select("id", "archived"), "id")


@query(
    "archive_totals",
    f"""SELECT count(*) AS snapshots, count(*) FILTER (WHERE checksum_ok) AS checksums_ok,
      count(*) FILTER (WHERE checksum_ok IS NULL) AS unverifiable, count(*) FILTER (WHERE NOT archived) AS errors
      FROM ({ARCHIVE_SQL})""",
)
def query_archive_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "archive")
    catalog = snapshot_catalog_on_disk(spark, sf_dir, f"{folder}/snapshots")
    return archive_totals(archive(spark, purge_candidates(catalog, 90, views.AS_OF), f"{folder}/archive"))


@query(
    "deleted_snapshots",
    """SELECT 'nation-' || s_nationkey AS id, true AS deleted, 0 AS left_in_catalog FROM (SELECT DISTINCT s_nationkey FROM supplier)""",
)
def deleted_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "delete")
    snapshot_catalog_on_disk(spark, sf_dir, f"{folder}/snapshots").write.parquet(f"{folder}/catalog")
    catalog = spark.read.parquet(f"{folder}/catalog")
    outcome, after = delete(spark, catalog, catalog.select("id"), f"{folder}/report")
    return outcome.select("id", "deleted", after.agg(F.count("*")).scalar().alias("left_in_catalog"))

