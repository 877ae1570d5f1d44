"""Differences, merges, fingerprints, cache decisions and whole ingests."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions.fingerprints import row_checksum
from barwright.operators.catalog import latest_per_ticker
from barwright.operators.diff import (
    cache_decisions,
    change_counts,
    changed_rows,
    classify_in_range,
    concat,
    diff,
    file_cache_decisions,
    file_tickers,
    key_difference,
    key_intersection,
    last_per_key,
    merge,
    merge_insert_only,
    new_rows,
    ticker_fingerprints,
)
from barwright.operators.ingest import (
    catalog_entries,
    create_snapshots,
    ingest_csv_folder,
    ingest_snapshot,
    latest_snapshot_json,
    latest_snapshot_rows,
)
from barwright.operators.integrity import verify_sidecars
from barwright.operators.prints import TablePrints
from barwright.plans import views
from barwright.plans.registry import query
from barwright.schema import PRICES, names
from barwright.session import scratch_dir
from barwright.sources.files import file_hashes, sidecar_hashes, write_csv_folders
from barwright.sources.log import ProcessedFiles
from barwright.sources.prices import export_csv
from barwright.sources.table import YearTable
from barwright.streaming.ingest import start_ingest

BAR = "ticker, date, open, high, low, close, volume, source"
SAME = "s.open = i.open AND s.high = i.high AND s.low = i.low AND s.close = i.close AND s.volume = i.volume"
JOINED = "incoming i LEFT JOIN stored s ON s.ticker = i.ticker AND s.date = i.date"
CHANGE = f"CASE WHEN s.ticker IS NULL THEN 'new' WHEN {SAME} THEN 'unchanged' ELSE 'changed' END"
ROW_TEXT = (
    "ticker || '|' || strftime(date, '%Y-%m-%d') || '|' || "
    + " || '|' || ".join(
        f"coalesce(CAST(CAST(round({c}, 10) AS DECIMAL(28,10)) AS VARCHAR), 'None')"
        for c in ("open", "high", "low", "close")
    )
    + " || '|' || coalesce(CAST(volume AS VARCHAR), 'None') || '|' || source"
)
WORD_SUMS = " || ',' || ".join(
    f"CAST(sum(CAST(('0x' || substr(h, {8 * i + 1}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(8)
)


def prints_sql(view: str) -> str:
    return f"""SELECT ticker, sha256(CAST(count(*) AS VARCHAR) || ',' || {WORD_SUMS}) AS checksum, count(*) AS rows
      FROM (SELECT ticker, sha256({ROW_TEXT}) AS h FROM {view}) GROUP BY ticker"""


MERGED_SQL = f"""SELECT {BAR} FROM incoming UNION ALL SELECT {BAR} FROM stored s
  WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.ticker = s.ticker AND i.date = s.date)"""


def stable(df: DataFrame) -> DataFrame:
    return df.drop("fetched_at", "raw_checksum")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return views.incoming(spark, sf_dir), views.stored(spark, sf_dir)


@query(
    "changed_and_new_rows",
    f"SELECT * FROM (SELECT i.*, {CHANGE} AS change_type FROM {JOINED}) WHERE change_type <> 'unchanged'",
    ("incoming", "stored"),
)
def changed_and_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable(diff(*sides(spark, sf_dir)))


@query("new_rows", f"SELECT i.* FROM {JOINED} WHERE s.ticker IS NULL", ("incoming", "stored"))
def query_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable(new_rows(*sides(spark, sf_dir)))


@query(
    "changed_rows",
    f"SELECT i.* FROM {JOINED} WHERE s.ticker IS NOT NULL AND NOT ({SAME})",
    ("incoming", "stored"),
)
def query_changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable(changed_rows(*sides(spark, sf_dir)))


@query(
    "change_counts",
    f"""SELECT ticker, count(*) FILTER (WHERE c <> 'unchanged') AS processed_rows,
      count(*) FILTER (WHERE c = 'unchanged') AS skipped_rows
      FROM (SELECT i.ticker, {CHANGE} AS c FROM {JOINED}) GROUP BY ticker""",
    ("incoming", "stored"),
)
def query_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_counts(classify_in_range(*sides(spark, sf_dir)))


@query(
    "store_keys_not_in_feed",
    "SELECT ticker, date FROM stored EXCEPT SELECT ticker, date FROM incoming",
    ("incoming", "stored"),
)
def store_keys_not_in_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, store = sides(spark, sf_dir)
    return key_difference(store, feed)


@query(
    "keys_in_both",
    "SELECT ticker, date FROM stored INTERSECT SELECT ticker, date FROM incoming",
    ("incoming", "stored"),
)
def keys_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_intersection(*sides(spark, sf_dir))


@query(
    "concatenated_rows",
    "SELECT ticker, date, close, NULL AS volume FROM stored UNION ALL SELECT ticker, date, close, volume FROM incoming",
    ("incoming", "stored"),
)
def concatenated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, store = sides(spark, sf_dir)
    return concat(store.select("ticker", "date", "close"), feed.select("ticker", "date", "close", "volume"))


@query(
    "last_row_per_key",
    """SELECT ticker, date, close, seq FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY seq DESC) AS rn
      FROM (SELECT split_part(feed_row, '#', 1) AS ticker, split_part(feed_row, '#', 2) AS date, close, seq FROM raw_quotes))
      WHERE rn = 1""",
    ("raw_quotes",),
)
def last_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("feed_row", "#")
    rows = views.raw_quotes(spark, sf_dir).select(
        parts[0].alias("ticker"), parts[1].alias("date"), F.col("Close").alias("close"), "seq"
    )
    return last_per_key(rows, sequence=("seq",))


@query("merged_prices", MERGED_SQL, ("incoming", "stored"))
def merged_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, store = sides(spark, sf_dir)
    return stable(merge(store, feed))


@query(
    "inserted_prices",
    f"""SELECT {BAR} FROM stored UNION ALL SELECT {BAR} FROM incoming i
      WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE i.ticker = s.ticker AND i.date = s.date)""",
    ("incoming", "stored"),
)
def inserted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, store = sides(spark, sf_dir)
    return stable(merge_insert_only(store, feed))


@query(
    "merged_catalog",
    """SELECT id, ticker, CASE WHEN archived THEN rows + 1 ELSE rows END AS rows, checksum FROM catalog""",
    ("catalog",),
)
def merged_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = views.catalog(spark, sf_dir)
    corrected = catalog.filter("archived").withColumn("rows", F.col("rows") + 1)
    return merge(catalog, corrected, ("id",)).select("id", "ticker", "rows", "checksum")


@query("row_checksums", f"SELECT ticker, date, sha256({ROW_TEXT}) AS row_checksum FROM stored", ("stored",))
def row_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.stored(spark, sf_dir).select("ticker", "date", row_checksum().alias("row_checksum"))


@query("ticker_fingerprints", prints_sql("stored"), ("stored",))
def query_ticker_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticker_fingerprints(views.stored(spark, sf_dir))


@query("table_fingerprints", prints_sql("merged"), ("merged",))
def table_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of a stored table, hashed when it is filled, then only where an upsert has written."""
    prices = stored_table(spark, sf_dir, scratch_dir(spark, "prints"))
    prints = TablePrints(spark, prices)
    prints.update()
    prices.upsert(views.incoming(spark, sf_dir))
    return prints.fingerprints()


@query(
    "table_cache_decisions",
    f"""SELECT n.ticker, n.rows, CASE WHEN o.checksum = n.checksum THEN 'checksum_match' ELSE 'miss' END AS decision
      FROM ({prints_sql('merged')}) n LEFT JOIN ({prints_sql('stored')}) o ON o.ticker = n.ticker""",
    ("merged",),
)
def table_cache_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tickers an upsert has changed, from the fingerprints of two versions of one table."""
    prices = stored_table(spark, sf_dir, scratch_dir(spark, "prints"))
    before = prices.version()
    prices.upsert(views.incoming(spark, sf_dir))
    prints = TablePrints(spark, prices)
    last = prints.fingerprints(before).select("ticker", F.col("checksum").alias("last_checksum"), F.lit(views.FETCHED).alias("generated_at"))
    return cache_decisions(prints.fingerprints(), last, views.AS_OF).drop("checksum")


CACHE_SQL = f"""SELECT n.ticker, n.rows, CASE WHEN o.checksum = n.checksum AND {{fresh}} THEN '{{hit}}' ELSE 'miss' END AS decision
  FROM ({prints_sql('bars_desk')}) n LEFT JOIN ({prints_sql('old')}) o ON o.ticker = n.ticker"""
CACHE_VIEWS = """SELECT * FROM (WITH bars_desk AS (SELECT *, 'desk' AS source FROM bars),
  old AS (SELECT ticker, date, open, high, low, CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 3 = 0 AND volume > 45
    THEN close + 1 ELSE close END AS close, volume, source FROM bars_desk) """


def cache_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    now = views.canonical(views.bars(spark, sf_dir))
    number = F.substring("ticker", 2, 7).cast("bigint")
    old = now.withColumn("close", F.when((number % 3 == 0) & (F.col("volume") > 45), F.col("close") + 1).otherwise(F.col("close")))
    hours = F.make_dt_interval(hours=(number % 48).cast("int"))
    last = ticker_fingerprints(old).select(
        "ticker",
        F.col("checksum").alias("last_checksum"),
        (F.lit(views.AS_OF).cast("timestamp") - hours).alias("generated_at"),
    )
    return ticker_fingerprints(now), last


@query(
    "cache_decisions",
    CACHE_VIEWS + CACHE_SQL.format(fresh="true", hit="checksum_match") + ")",
    ("bars",),
)
def query_cache_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_decisions(*cache_inputs(spark, sf_dir), views.AS_OF).drop("checksum")


@query(
    "cache_decisions_with_ttl",
    CACHE_VIEWS + CACHE_SQL.format(fresh="CAST(substr(n.ticker, 2) AS BIGINT) % 48 < 24", hit="within_ttl") + ")",
    ("bars",),
)
def cache_decisions_with_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_decisions(*cache_inputs(spark, sf_dir), views.AS_OF, ttl_seconds=86400).drop("checksum")


@query(
    "file_cache_decisions",
    """SELECT c.path, c.sha256, coalesce(c.sha256 = e.sha256 AND e.n % 3 = 1, false) AS cached FROM current_files c
      LEFT JOIN (SELECT *, CAST(split_part(path, '/', 2) AS BIGINT) AS n FROM expected_files) e ON e.path = c.path""",
    ("expected_files", "current_files"),
)
def query_file_cache_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.split("path", "/")[1].cast("bigint") % 3
    at = F.when(number == 0, "garbage").when(number == 1, "2000-06-30T23:30:00").otherwise("2000-06-01T00:00:00")
    processed = views.manifest(spark, sf_dir, current=False).withColumn("processed_at", at)
    return file_cache_decisions(views.manifest(spark, sf_dir, current=True), processed, views.AS_OF, ttl_seconds=3600)


@query(
    "file_tickers",
    """SELECT file, CASE WHEN count(DISTINCT ticker) = 1 THEN min(ticker) END AS ticker, count(DISTINCT ticker) > 1 AS ambiguous
      FROM (SELECT ticker, CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 4 = 0 THEN 'mixed-' || year(date)
        ELSE ticker || '-' || year(date) END AS file FROM bars) GROUP BY file""",
    ("bars",),
)
def query_file_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.bars(spark, sf_dir).selectExpr(
        "ticker",
        "CASE WHEN cast(substr(ticker, 2) as bigint) % 4 = 0 THEN concat('mixed-', year(date)) "
        "ELSE concat(ticker, '-', year(date)) END AS file",
    )
    return file_tickers(rows)


def stored_table(spark: SparkSession, sf_dir: str, folder: str) -> YearTable:
    prices = YearTable(spark, f"{folder}/prices")
    prices.upsert(views.stored(spark, sf_dir))
    return prices


@query("table_after_upserts", MERGED_SQL, ("incoming", "stored"))
def table_after_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = stored_table(spark, sf_dir, scratch_dir(spark, "table"))
    feed = views.incoming(spark, sf_dir)
    prices.upsert(feed)
    prices.upsert(feed)  # once more: nothing may change
    return stable(prices.read())


INGEST_SQL = f"""SELECT n.ticker, CASE WHEN o.checksum = n.checksum THEN 'checksum_match' ELSE 'miss' END AS decision,
  CASE WHEN o.checksum = n.checksum THEN 0 ELSE d.p END AS processed_rows,
  CASE WHEN o.checksum = n.checksum THEN 0 ELSE d.k END AS skipped_rows
  FROM ({prints_sql('incoming')}) n LEFT JOIN ({prints_sql('old')}) o ON o.ticker = n.ticker
  JOIN (SELECT ticker, count(*) FILTER (WHERE c <> 'unchanged') AS p, count(*) FILTER (WHERE c = 'unchanged') AS k
    FROM (SELECT i.ticker, {CHANGE} AS c FROM {JOINED}) GROUP BY ticker) d ON d.ticker = n.ticker"""


@query(
    "snapshot_ingest_report",
    f"""SELECT * FROM (WITH old AS (SELECT * FROM incoming WHERE CAST(substr(ticker, 2) AS BIGINT) % 2 = 0 OR volume < 40)
      {INGEST_SQL})""",
    ("incoming", "stored"),
)
def snapshot_ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "ingest")
    feed = views.incoming(spark, sf_dir)
    older = feed.filter("cast(substr(ticker, 2) as bigint) % 2 = 0 OR volume < 40")  # what an earlier pull saw
    known = ticker_fingerprints(older).withColumn("decision", F.lit("miss"))
    catalog = catalog_entries(known, "/data", views.FETCHED)
    result = ingest_snapshot(
        spark, feed, stored_table(spark, sf_dir, folder), catalog, f"{folder}/run", views.AS_OF
    )
    return result.report.select("ticker", "decision", "processed_rows", "skipped_rows")


@query("prices_after_snapshot_ingest", MERGED_SQL, ("incoming", "stored"))
def prices_after_snapshot_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "ingest")
    prices = stored_table(spark, sf_dir, folder)
    no_history = views.catalog(spark, sf_dir)  # other tickers only
    ingest_snapshot(spark, views.incoming(spark, sf_dir), prices, no_history, f"{folder}/run", views.AS_OF)
    return stable(prices.read())


def write_feed_files(df: DataFrame, folder: str) -> None:
    """Snapshot files of one ticker and year each."""
    rows = df.select(F.col("ticker").alias("_t"), F.year("date").alias("_y"), *names(PRICES))
    write_csv_folders(rows.repartition("_t", "_y"), folder, ("_t", "_y"))


@query("prices_after_file_ingest", MERGED_SQL, ("incoming", "stored"))
def prices_after_file_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "files")
    prices = stored_table(spark, sf_dir, folder)
    write_feed_files(views.incoming(spark, sf_dir), f"{folder}/inbox")
    nothing = spark.createDataFrame([], "path string, sha256 string, processed_at string")
    ingest_csv_folder(spark, f"{folder}/inbox", prices, nothing, f"{folder}/work", views.AS_OF)
    return stable(prices.read())


@query("prices_after_stream_ingest", MERGED_SQL, ("incoming", "stored"))
def prices_after_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "stream")
    prices = stored_table(spark, sf_dir, folder)
    write_feed_files(views.incoming(spark, sf_dir), f"{folder}/inbox")
    for _ in range(2):  # the second run finds no new files
        start_ingest(
            spark, f"{folder}/inbox", prices, f"{folder}/checkpoint", f"{folder}/work", views.FETCHED
        ).awaitTermination()
    return stable(prices.read())


@query(
    "created_snapshots",
    f"""SELECT p.ticker, p.rows, p.checksum, true AS sized, 'ok' AS status FROM ({prints_sql('stored')}) p""",
    ("stored",),
)
def created_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, sidecars and catalog rows of one operator; every file is then verified against its sidecar."""
    folder = scratch_dir(spark, "create")
    catalog = create_snapshots(spark, views.stored(spark, sf_dir), folder, views.AS_OF, "job-1")
    files = verify_sidecars(file_hashes(spark, folder, "*.csv"), sidecar_hashes(spark, folder))
    ticker = F.regexp_extract("path", "_ticker=([^/]+)/", 1).alias("ticker")
    status = files.groupBy(ticker).agg(F.array_join(F.array_sort(F.collect_set("status")), ",").alias("status"))
    return catalog.join(status, "ticker").select("ticker", "rows", "checksum", (F.col("size_bytes") > 0).alias("sized"), "status")


def two_generations(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The catalog of two generations of snapshots, the later one with the incoming bars."""
    older = views.stored(spark, sf_dir)
    newer = merge(older, views.incoming(spark, sf_dir))
    catalogs = [
        create_snapshots(spark, rows, f"{folder}/{n}", views.AS_OF + timedelta(days=n)) for n, rows in enumerate((older, newer))
    ]
    return concat(*catalogs)


@query("latest_snapshot_export", MERGED_SQL, ("incoming", "stored"))
def latest_snapshot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of the latest snapshots holds the rows of the later generation, and reads nothing of the older one."""
    folder = scratch_dir(spark, "generations")
    rows = latest_snapshot_rows(spark, two_generations(spark, sf_dir, folder))
    export_csv(rows, f"{folder}-export/csv")
    back = spark.read.schema(rows.schema).csv(f"{folder}-export/csv", header=True)
    return stable(back)


@query(
    "latest_snapshot_documents",
    f"""SELECT p.ticker, p.checksum, p.rows, m.close_total, m.first_date FROM ({prints_sql('merged')}) p JOIN (
      SELECT ticker, CAST(sum(CAST(round(close * 10000) AS BIGINT)) AS BIGINT) AS close_total, strftime(min(date), '%Y-%m-%d') AS first_date
      FROM merged GROUP BY ticker) m ON m.ticker = p.ticker""",
    ("merged",),
)
def latest_snapshot_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest snapshots as JSON documents, each with the checksum of its own catalog row."""
    folder = scratch_dir(spark, "documents")
    latest_snapshot_json(spark, two_generations(spark, sf_dir, folder), f"{folder}-export/json")
    schema = "ticker string, checksum string, rows long, data array<struct<date: string, close: double>>"
    document = F.from_json("value", schema)
    documents = spark.read.text(f"{folder}-export/json").select(document.alias("d")).select("d.*")
    cents = F.transform("data", lambda bar: F.round(bar["close"] * 10000).cast("bigint"))
    return documents.select(
        "ticker", "checksum", "rows",
        F.aggregate(cents, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("close_total"),
        F.array_min("data.date").alias("first_date"),
    )


def feed_with_faults(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """An older file set with a wrong bar and a bad date here and there, then the right bars in later files."""
    feed = views.incoming(spark, sf_dir)
    older = feed.filter("volume % 10 = 1").withColumn("open", F.col("high") + 1000)  # the larger values must not win
    wrong = feed.filter("volume % 10 = 0").withColumn("date", F.lit("no day"))
    columns = [F.col(c).cast("string").alias(c) for c in feed.columns]
    write_feed_files(older.withColumn("high", F.col("open")), f"{folder}/one 1+")
    rows = feed.select(*columns).unionByName(wrong.select(*columns))
    rows = rows.select(F.col("ticker").alias("_t"), *names(PRICES))
    write_csv_folders(rows.repartition("_t"), f"{folder}/two 2%", ("_t",))


def faulty_ingest(spark: SparkSession, sf_dir: str):
    folder = scratch_dir(spark, "faults")
    prices = stored_table(spark, sf_dir, folder)
    feed_with_faults(spark, sf_dir, f"{folder}/inbox")
    nothing = spark.createDataFrame([], "path string, sha256 string, processed_at string")
    return prices, ingest_csv_folder(spark, f"{folder}/inbox", prices, nothing, f"{folder}/work", views.AS_OF)


@query("prices_after_faulty_files", MERGED_SQL, ("incoming", "stored"))
def prices_after_faulty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later files correct earlier ones, and bad rows do not hide good ones; folder names hold blanks, ``+`` and ``%``."""
    prices, _ = faulty_ingest(spark, sf_dir)
    return stable(prices.read())


@query(
    "file_ingest_counts",
    f"""SELECT ticker, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(p) AS BIGINT) AS processed_rows, CAST(sum(k) AS BIGINT) AS skipped_rows,
      CAST(sum(older) AS BIGINT) AS superseded_rows, CAST(sum(wrong) AS BIGINT) AS invalid_rows FROM (
      SELECT ticker, 1 + older + wrong AS n, CASE WHEN c <> 'unchanged' THEN 1 ELSE 0 END AS p,
        CASE WHEN c = 'unchanged' THEN 1 ELSE 0 END AS k, older, wrong FROM (
        SELECT i.ticker, {CHANGE} AS c, CASE WHEN i.volume % 10 = 1 THEN 1 ELSE 0 END AS older,
          CASE WHEN i.volume % 10 = 0 THEN 1 ELSE 0 END AS wrong FROM {JOINED})) GROUP BY ticker""",
    ("incoming", "stored"),
)
def file_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every file is new or changed, unchanged, superseded or invalid."""
    _, result = faulty_ingest(spark, sf_dir)
    counts = ("rows", "processed_rows", "skipped_rows", "superseded_rows", "invalid_rows")
    by_ticker = result.report.groupBy(F.regexp_extract("path", "_t=([^/]+)", 1).alias("ticker"))
    return by_ticker.agg(*(F.sum(c).alias(c) for c in counts))


def feed_with_headers(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The incoming bars in files of three column orders, one of them in capitals and with a column more, beside broken files."""
    feed = views.incoming(spark, sf_dir)
    part = F.crc32(F.col("ticker").cast("binary")) % 3
    columns = names(PRICES)
    orders = (columns, columns[::-1], [*columns[3:], "note", *columns[:3]])
    for n, order in enumerate(orders):
        rows = feed.filter(part == n).withColumn("note", F.lit("x, y"))
        rows = rows.select(F.col("ticker").alias("_t"), *(F.col(c).alias(c.upper() if n == 2 else c) for c in order))
        write_csv_folders(rows.repartition("_t"), f"{folder}/order{n}", ("_t",))
    strange = feed.groupBy("ticker").agg(F.count("*").alias("bars"))  # a table of another kind among the files
    strange = strange.select(F.col("ticker").alias("_t"), "bars", F.lit("?").alias("date"))
    write_csv_folders(strange.repartition("_t"), f"{folder}/strange", ("_t",))


def mixed_ingest(spark: SparkSession, sf_dir: str):
    folder = scratch_dir(spark, "headers")
    prices = stored_table(spark, sf_dir, folder)
    feed_with_headers(spark, sf_dir, f"{folder}/inbox")
    processed = ProcessedFiles(spark, f"{folder}/processed")
    runs = [ingest_csv_folder(spark, f"{folder}/inbox", prices, processed, f"{folder}/work{n}", views.AS_OF) for n in range(2)]
    return prices, processed, runs


@query(
    "mixed_header_ingest",
    f"""SELECT ticker, run, decision, reason, CAST(count(*) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS rows,
      CAST(sum(p) AS BIGINT) AS processed_rows, CAST(sum(k) AS BIGINT) AS skipped_rows FROM (
      SELECT i.ticker, 0 AS run, 'ingest' AS decision, NULL AS reason, count(*) AS n,
        count(*) FILTER (WHERE {CHANGE} <> 'unchanged') AS p, count(*) FILTER (WHERE {CHANGE} = 'unchanged') AS k FROM {JOINED} GROUP BY i.ticker
      UNION ALL SELECT DISTINCT ticker, 1, 'cached', NULL, 0, 0, 0 FROM incoming
      UNION ALL SELECT DISTINCT ticker, run, 'bad_header', 'header lacks ticker', 0, 0, 0 FROM incoming, (VALUES (0), (1)) r(run))
      GROUP BY ALL""",
    ("incoming", "stored"),
)
def mixed_header_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over files of several headers: the first reads every usable file, the second opens only the refused ones."""
    _, _, runs = mixed_ingest(spark, sf_dir)
    ticker = F.regexp_extract("path", "_t=([^/]+)", 1).alias("ticker")
    reports = [r.report.withColumn("run", F.lit(n)) for n, r in enumerate(runs)]
    grouped = concat(*reports).groupBy(ticker, "run", "decision", "reason")
    return grouped.agg(
        F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("rows", "processed_rows", "skipped_rows"))
    )


@query("prices_after_mixed_headers", MERGED_SQL, ("incoming", "stored"))
def prices_after_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever the order of its columns, every file's rows arrive, and strange files hold up nothing."""
    prices, _, _ = mixed_ingest(spark, sf_dir)
    return stable(prices.read())


@query("prices_after_mixed_stream", MERGED_SQL, ("incoming", "stored"))
def prices_after_mixed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream, in several batches; the log of processed files then covers a batch run."""
    folder = scratch_dir(spark, "mixed-stream")
    prices = stored_table(spark, sf_dir, folder)
    feed_with_headers(spark, sf_dir, f"{folder}/inbox")
    start_ingest(
        spark, f"{folder}/inbox", prices, f"{folder}/checkpoint", f"{folder}/work", views.FETCHED,
        processed=ProcessedFiles(spark, f"{folder}/processed"),
    ).awaitTermination()
    return stable(prices.read())


@query(
    "processed_files",
    """SELECT DISTINCT ticker, 1 AS files, true AS hashed, 0 AS unlike FROM incoming""",
    ("incoming",),
)
def processed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of processed files after two runs: one entry a file, with the size and the hash that the file has."""
    prices, processed, _ = mixed_ingest(spark, sf_dir)
    folder = prices.root.rsplit("/", 1)[0]
    now = file_hashes(spark, f"{folder}/inbox", "*.csv").select("path", F.col("sha256").alias("now"), F.col("size_bytes").alias("size"))
    ticker = F.regexp_extract("path", "_t=([^/]+)", 1).alias("ticker")
    unlike = ~F.col("now").eqNullSafe(F.col("sha256")) | ~F.col("size").eqNullSafe(F.col("size_bytes"))
    joined = processed.newest().join(now, "path", "left")
    return joined.groupBy(ticker).agg(
        F.count("*").cast("int").alias("files"), F.bool_and(F.length("sha256") == 64).alias("hashed"), F.count_if(unlike).cast("int").alias("unlike")
    )


@query("prices_after_two_streams", MERGED_SQL, ("incoming", "stored"))
def prices_after_two_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams feed one table, with a plain upsert between them and both run again after it."""
    folder = scratch_dir(spark, "streams")
    prices = stored_table(spark, sf_dir, folder)
    feed = views.incoming(spark, sf_dir)
    halves = [feed.filter(F.crc32(F.col("ticker").cast("binary")) % 2 == n) for n in range(2)]
    for n, half in enumerate(halves):
        write_feed_files(half, f"{folder}/inbox{n}")

    def run(n: int) -> None:
        start_ingest(
            spark, f"{folder}/inbox{n}", prices, f"{folder}/checkpoint{n}", f"{folder}/work", views.FETCHED
        ).awaitTermination()

    run(0)
    prices.upsert(halves[1].withColumn("close", F.lit(1.0)).filter("volume % 2 = 0"))  # the second stream corrects these
    run(1)
    run(0)
    return stable(prices.read())


@query("prices_after_renamed_upsert", MERGED_SQL, ("incoming", "stored"))
def prices_after_renamed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that name their ticker in other forms meet the stored rows of the same ticker."""
    prices = stored_table(spark, sf_dir, scratch_dir(spark, "forms"))
    other = F.concat(F.lit(" "), F.lower("ticker"), F.lit(".sa "))
    prices.upsert(views.incoming(spark, sf_dir).withColumn("ticker", F.when(F.col("volume") % 2 == 0, other).otherwise(F.col("ticker"))))
    return stable(prices.read())


@query(
    "prices_of_tickers",
    f"SELECT {BAR} FROM stored WHERE ticker IN ('S0000001', 'S0000002', 'S0000007') AND date >= DATE '1993-01-01'",
    ("stored",),
)
def prices_of_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named tickers, in any form, from the buckets and years that hold them."""
    prices = stored_table(spark, sf_dir, scratch_dir(spark, "tickers"))
    return stable(prices.read(["S0000001", " s0000002.sa", "S0000007.SA", "S9999999"], start="1993-01-01"))


@query(
    "latest_snapshots",
    """SELECT id, ticker, strftime(created_at, '%Y-%m-%d') AS created_on, snapshot_path, rows FROM (SELECT *,
      row_number() OVER (PARTITION BY ticker ORDER BY created_at DESC, id DESC) AS rn FROM catalog) WHERE rn = 1""",
    ("catalog",),
)
def latest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = latest_per_ticker(views.catalog(spark, sf_dir))
    return latest.select("id", "ticker", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"), "snapshot_path", "rows")
