"""Market-price views over the generic test tables, in Spark and as SQL text.

Each Spark view has a SQL twin in :data:`SQL` that gives the same rows, so that results can be compared. Prices
are whole ten-thousandths until the last step, which makes every engine agree on each digit.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORE_UNTIL = date(1999, 1, 1)  # the store holds bars before this day
FEED_SINCE = date(1998, 1, 1)  # the feed brings bars from this day on
FETCHED = datetime(2024, 1, 31)
AS_OF = datetime(2000, 7, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per supplier and ship date: the supplier is the ticker, each order line a trade.

    Every aggregate works on whole numbers, so it is exact, and combines on the map side by hashing.
    """
    trades = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('S', lpad(cast(l_suppkey as string), 7, '0')) AS ticker",
        "cast(l_shipdate as date) AS date",
        "(cast(round(l_extendedprice * 100) as bigint) * 100) div cast(l_quantity as bigint) AS p",
        "cast(l_quantity as bigint) AS q",
    )
    return (
        trades.groupBy("ticker", "date")
        .agg(
            F.max("p").alias("_high"),
            F.min("p").alias("_low"),
            F.sum(F.col("p") * F.col("q")).alias("_value"),
            F.sum("q").alias("volume"),
        )
        .selectExpr(
            "ticker",
            "date",
            "((_high + _low) div 2) / 10000D AS open",
            "_high / 10000D AS high",
            "_low / 10000D AS low",
            "(_value div volume) / 10000D AS close",
            "volume",
        )
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per event type and day, with the first and last value by event number."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.expr("concat(upper(substr(event_type, 1, 4)), '3')").alias("ticker"),
            F.expr("cast(ts as date)").alias("date"),
        )
        .agg(
            F.min_by("value", "event_id").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "event_id").alias("close"),
            F.count("*").alias("volume"),
        )
    )


KEY = "(cast(substr(ticker, 2) as bigint) * 31 + datediff(date, DATE '1992-01-01'))"


def canonical(df: DataFrame, source: str = "desk") -> DataFrame:
    """Bars with the remaining canonical columns."""
    return df.selectExpr(
        "ticker",
        "date",
        "open",
        "high",
        "low",
        "close",
        "volume",
        f"'{source}' AS source",
        f"TIMESTAMP '{FETCHED}' AS fetched_at",
        "sha2(concat_ws('|', ticker, date), 256) AS raw_checksum",
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds: early bars, some of them with an older close."""
    early = bars(spark, sf_dir).filter(F.col("date") < F.lit(STORE_UNTIL))
    return canonical(early.withColumn("close", F.expr(f"CASE WHEN {KEY} % 50 = 0 THEN close + 0.5D ELSE close END")))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the feed brings: later bars, overlapping the store by a year."""
    return canonical(bars(spark, sf_dir).filter(F.col("date") >= F.lit(FEED_SINCE)))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with missing and zero closes."""
    return bars(spark, sf_dir).selectExpr(
        "ticker",
        "date",
        f"CASE WHEN {KEY} % 11 = 0 THEN NULL WHEN {KEY} % 13 = 0 THEN 0D WHEN {KEY} % 17 = 0 THEN double('NaN') "
        "ELSE close END AS close",
    )


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw feed as text: provider headers, mixed ticker and date forms, faults, and repeated rows."""
    keyed = bars(spark, sf_dir).withColumn("k", F.expr(KEY))
    copies = keyed.withColumn("seq", F.explode(F.expr("CASE WHEN k % 89 = 0 THEN array(1, 2) ELSE array(1) END")))

    def text(value: str) -> str:
        return f"cast(cast({value} as decimal(18,4)) as string)"

    return copies.selectExpr(
        "CASE WHEN k % 127 = 0 THEN '??' WHEN k % 3 = 0 THEN concat(' ', lower(ticker), '.sa ') ELSE ticker END AS Ticker",
        "CASE WHEN k % 103 = 0 THEN 'not a date' WHEN k % 5 = 0 THEN date_format(date, 'MM-dd-yyyy') "
        "ELSE cast(date as string) END AS Date",
        f"CASE WHEN k % 97 = 0 THEN 'bad' ELSE {text('open')} END AS Open",
        f"CASE WHEN k % 107 = 0 THEN {text('low')} ELSE {text('high')} END AS High",
        f"CASE WHEN k % 107 = 0 THEN {text('high')} ELSE {text('low')} END AS Low",
        f"CASE WHEN k % 109 = 0 THEN NULL ELSE {text('close + seq - 1')} END AS Close",
        f"CASE WHEN k % 2 = 0 THEN {text('close')} END AS `Adj Close`",
        "CASE WHEN k % 101 = 0 THEN '12.5' WHEN k % 113 = 0 THEN '-5' WHEN k % 7 = 0 THEN concat(volume, '.0') "
        "ELSE cast(volume as string) END AS Volume",
        "CASE WHEN k % 4 = 0 THEN 'alpha' ELSE 'beta' END AS provider",
        "concat_ws('#', ticker, date_format(date, 'yyyyMMdd'), seq) AS feed_row",
        "seq",
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw feed under canonical column names, still as text, ready for the quality rules."""
    return raw_quotes(spark, sf_dir).selectExpr(
        "Ticker AS ticker",
        "CASE WHEN Date RLIKE '^[0-9]{2}-' THEN concat_ws('-', substr(Date, 7, 4), substr(Date, 1, 5)) ELSE Date END AS date",
        "Open AS open",
        "High AS high",
        "Low AS low",
        "Close AS close",
        "Volume AS volume",
        "CASE WHEN seq = 1 THEN provider END AS source",
        f"TIMESTAMP '{FETCHED}' AS fetched_at",
        "sha2(feed_row, 256) AS raw_checksum",
        "provider",
        "feed_row",
        "seq",
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot catalog: one row per order, the customer is the ticker."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('snap-', o_orderkey) AS id",
        "concat('C', lpad(cast(o_custkey as string), 7, '0')) AS ticker",
        "cast(o_orderdate as timestamp) AS created_at",
        "CASE pmod(o_orderkey, 4) "
        "WHEN 0 THEN concat('{\"start\":\"', date_format(o_orderdate, 'yyyy-MM-dd'), '\",\"end_date\":\"', "
        "date_format(date_add(o_orderdate, 30), 'yyyyMMdd'), '\"}') "
        "WHEN 1 THEN concat('{\"start_date\":\"', date_format(o_orderdate, 'yyyyMMdd'), '\"}') "
        "WHEN 2 THEN 'not json' END AS payload",
        "CASE pmod(o_orderkey, 5) "
        "WHEN 0 THEN concat('/tmp/C', lpad(cast(o_custkey as string), 7, '0'), '-', "
        "date_format(o_orderdate, \"yyyyMMdd'T'HHmmss\"), '-', o_orderkey, '.csv') "
        "WHEN 1 THEN concat('/data/snapshots/C', lpad(cast(o_custkey as string), 7, '0'), '-', "
        "date_format(o_orderdate, \"yyyyMMdd'T'HHmmss\"), 'Z-', o_orderkey, '.csv') "
        "WHEN 2 THEN concat('/data/snapshots/', o_orderkey, '_', date_format(o_orderdate, 'yyyy-MM-dd'), '_to_', "
        "date_format(date_add(o_orderdate, 9), 'yyyy-MM-dd'), '.csv') "
        "WHEN 3 THEN concat('/data/snapshots/C', lpad(cast(o_custkey as string), 7, '0'), '.SA-', "
        "date_format(o_orderdate, \"yyyyMMdd'T'HHmmss\"), 'Z-', o_orderkey, '.csv') END AS snapshot_path",
        "cast(floor(o_totalprice / 1000) as bigint) AS rows",
        "CASE WHEN pmod(o_orderkey, 7) = 0 THEN NULL ELSE sha2(concat('snap-', o_orderkey), 256) END AS checksum",
        "cast(NULL as string) AS job_id",
        "cast(floor(o_totalprice) as bigint) AS size_bytes",
        "o_orderstatus = 'F' AS archived",
        "CASE WHEN o_orderstatus = 'F' THEN cast(date_add(o_orderdate, 90) as timestamp) END AS archived_at",
    )


def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the files behind the catalog: some files are gone, some hold other bytes."""
    priorities = table(spark, sf_dir, "orders").selectExpr("concat('snap-', o_orderkey) AS id", "o_orderpriority")
    return (
        catalog(spark, sf_dir)
        .join(priorities, "id")
        .filter("snapshot_path IS NOT NULL AND o_orderpriority != '5-LOW'")
        .selectExpr(
            "snapshot_path AS path",
            "CASE WHEN o_orderpriority = '1-URGENT' THEN sha2(concat('x', id), 256) ELSE sha2(id, 256) END AS sha256",
        )
    )


def manifest(spark: SparkSession, sf_dir: str, current: bool) -> DataFrame:
    """Hashes of the documents: as expected, or as found after files were lost, added and changed."""
    docs = table(spark, sf_dir, "documents")
    if not current:
        return docs.selectExpr(
            "CASE WHEN n_chars % 10 = 1 THEN concat('old/', doc_id) ELSE concat('docs/', doc_id) END AS path",
            "sha2(text, 256) AS sha256",
        )
    return docs.selectExpr(
        "CASE WHEN n_chars % 10 = 2 THEN concat('new/', doc_id) ELSE concat('docs/', doc_id) END AS path",
        "CASE WHEN n_chars % 10 = 3 THEN sha2(concat(text, '!'), 256) ELSE sha2(text, 256) END AS sha256",
    )


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ingest job per event."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('job-', event_id) AS job_id",
        "concat('U', lpad(cast(user_id as string), 6, '0')) AS ticker",
        "event_type AS source",
        "CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status",
        "cast(date_trunc('second', ts) as timestamp) AS started_at",
        "timestamp_seconds(unix_seconds(cast(ts as timestamp)) + cast(floor(value) as bigint)) AS finished_at",
        "cast(get_json_object(props, '$.k') as bigint) AS rows",
        "CASE WHEN event_type = 'error' THEN 'failed' END AS error_message",
        "props AS extras",
    )


# The same views as SQL text. Each names the views it needs.
_KEY_SQL = "(CAST(substr(ticker, 2) AS BIGINT) * 31 + date_diff('day', DATE '1992-01-01', date))"
_TEXT = "CAST(CAST({} AS DECIMAL(18,4)) AS VARCHAR)"
_TICKER = "'C' || lpad(CAST(o_custkey AS VARCHAR), 7, '0')"
_STAMP = "strftime(o_orderdate, '%Y%m%dT%H%M%S')"

SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "trades": (
        (),
        """SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') AS ticker, CAST(l_shipdate AS DATE) AS date,
          (CAST(round(l_extendedprice * 100) AS BIGINT) * 100) // CAST(l_quantity AS BIGINT) AS p,
          CAST(l_quantity AS BIGINT) AS q FROM lineitem""",
    ),
    "bars": (
        ("trades",),
        """SELECT ticker, date,
          CAST((max(p) + min(p)) // 2 AS DOUBLE) / CAST(10000 AS DOUBLE) AS open,
          CAST(max(p) AS DOUBLE) / CAST(10000 AS DOUBLE) AS high,
          CAST(min(p) AS DOUBLE) / CAST(10000 AS DOUBLE) AS low,
          CAST(CAST(sum(p * q) AS BIGINT) // CAST(sum(q) AS BIGINT) AS DOUBLE) / CAST(10000 AS DOUBLE) AS close,
          CAST(sum(q) AS BIGINT) AS volume FROM trades GROUP BY ALL""",
    ),
    "event_bars": (
        (),
        """SELECT upper(substr(event_type, 1, 4)) || '3' AS ticker, CAST(ts AS DATE) AS date,
          arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close,
          count(*) AS volume FROM events GROUP BY ALL""",
    ),
    "keyed": (("bars",), f"SELECT *, {_KEY_SQL} AS k FROM bars"),
    "gappy": (
        ("keyed",),
        """SELECT ticker, date, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN CAST(0 AS DOUBLE)
          WHEN k % 17 = 0 THEN NULL ELSE close END AS close FROM keyed""",
    ),
    "stored": (
        ("keyed",),
        f"""SELECT ticker, date, open, high, low, CASE WHEN k % 50 = 0 THEN close + 0.5 ELSE close END AS close, volume,
          'desk' AS source FROM keyed WHERE date < DATE '{STORE_UNTIL}'""",
    ),
    "incoming": (
        ("keyed",),
        f"""SELECT ticker, date, open, high, low, close, volume, 'desk' AS source FROM keyed
          WHERE date >= DATE '{FEED_SINCE}'""",
    ),
    "merged": (
        ("stored", "incoming"),
        """SELECT * FROM incoming UNION ALL SELECT * FROM stored s
          WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.ticker = s.ticker AND i.date = s.date)""",
    ),
    "raw_quotes": (
        ("keyed",),
        f"""SELECT CASE WHEN k % 127 = 0 THEN '??' WHEN k % 3 = 0 THEN ' ' || lower(ticker) || '.sa ' ELSE ticker END AS ticker,
          CASE WHEN k % 103 = 0 THEN 'not a date' WHEN k % 5 = 0 THEN strftime(date, '%m-%d-%Y')
            ELSE strftime(date, '%Y-%m-%d') END AS date,
          CASE WHEN k % 97 = 0 THEN 'bad' ELSE {_TEXT.format('open')} END AS open,
          CASE WHEN k % 107 = 0 THEN {_TEXT.format('low')} ELSE {_TEXT.format('high')} END AS high,
          CASE WHEN k % 107 = 0 THEN {_TEXT.format('high')} ELSE {_TEXT.format('low')} END AS low,
          CASE WHEN k % 109 = 0 THEN NULL ELSE {_TEXT.format('close + seq - 1')} END AS close,
          CASE WHEN k % 2 = 0 THEN {_TEXT.format('close')} END AS adj_close,
          CASE WHEN k % 101 = 0 THEN '12.5' WHEN k % 113 = 0 THEN '-5' WHEN k % 7 = 0 THEN volume || '.0'
            ELSE CAST(volume AS VARCHAR) END AS volume,
          CASE WHEN k % 4 = 0 THEN 'alpha' ELSE 'beta' END AS provider,
          ticker || '#' || strftime(date, '%Y%m%d') || '#' || seq AS feed_row, seq
          FROM (SELECT *, unnest(CASE WHEN k % 89 = 0 THEN [1, 2] ELSE [1] END) AS seq FROM keyed)""",
    ),
    "quotes": (
        ("raw_quotes",),
        """SELECT ticker, CASE WHEN regexp_matches(date, '^[0-9]{2}-') THEN substr(date, 7, 4) || '-' || substr(date, 1, 5)
          ELSE date END AS date, open, high, low, close, volume, CASE WHEN seq = 1 THEN provider END AS source,
          provider, feed_row, seq FROM raw_quotes""",
    ),
    "typed": (
        ("quotes",),
        """SELECT ticker, TRY_CAST(date AS DATE) AS date, TRY_CAST(open AS DOUBLE) AS open,
          TRY_CAST(high AS DOUBLE) AS high, TRY_CAST(low AS DOUBLE) AS low, TRY_CAST(close AS DOUBLE) AS close,
          CASE WHEN TRY_CAST(volume AS DOUBLE) = floor(TRY_CAST(volume AS DOUBLE))
            THEN CAST(TRY_CAST(volume AS DOUBLE) AS BIGINT) END AS volume,
          source, provider, feed_row, seq, date AS raw_date, open AS raw_open, volume AS raw_volume FROM quotes""",
    ),
    "catalog": (
        (),
        f"""SELECT 'snap-' || o_orderkey AS id, {_TICKER} AS ticker, o_orderdate AS created_at,
          CASE o_orderkey % 4
            WHEN 0 THEN '{{"start":"' || strftime(o_orderdate, '%Y-%m-%d') || '","end_date":"'
              || strftime(o_orderdate + INTERVAL 30 DAY, '%Y%m%d') || '"}}'
            WHEN 1 THEN '{{"start_date":"' || strftime(o_orderdate, '%Y%m%d') || '"}}'
            WHEN 2 THEN 'not json' END AS payload,
          CASE o_orderkey % 5
            WHEN 0 THEN '/tmp/' || {_TICKER} || '-' || {_STAMP} || '-' || o_orderkey || '.csv'
            WHEN 1 THEN '/data/snapshots/' || {_TICKER} || '-' || {_STAMP} || 'Z-' || o_orderkey || '.csv'
            WHEN 2 THEN '/data/snapshots/' || o_orderkey || '_' || strftime(o_orderdate, '%Y-%m-%d') || '_to_'
              || strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') || '.csv'
            WHEN 3 THEN '/data/snapshots/' || {_TICKER} || '.SA-' || {_STAMP} || 'Z-' || o_orderkey || '.csv'
            END AS snapshot_path,
          CAST(floor(o_totalprice / 1000) AS BIGINT) AS rows,
          CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE sha256('snap-' || o_orderkey) END AS checksum,
          CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderstatus = 'F' AS archived,
          CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 90 DAY END AS archived_at,
          o_orderpriority AS priority FROM orders""",
    ),
    "files": (
        ("catalog",),
        """SELECT snapshot_path AS path,
          CASE WHEN priority = '1-URGENT' THEN sha256('x' || id) ELSE sha256(id) END AS sha256
          FROM catalog WHERE snapshot_path IS NOT NULL AND priority <> '5-LOW'""",
    ),
    "expected_files": (
        (),
        """SELECT CASE WHEN n_chars % 10 = 1 THEN 'old/' || doc_id ELSE 'docs/' || doc_id END AS path,
          sha256(text) AS sha256 FROM documents""",
    ),
    "current_files": (
        (),
        """SELECT CASE WHEN n_chars % 10 = 2 THEN 'new/' || doc_id ELSE 'docs/' || doc_id END AS path,
          CASE WHEN n_chars % 10 = 3 THEN sha256(text || '!') ELSE sha256(text) END AS sha256 FROM documents""",
    ),
    "job_log": (
        (),
        """SELECT 'job-' || event_id AS job_id, 'U' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS ticker,
          event_type AS source, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
          date_trunc('second', ts) AS started_at,
          date_trunc('second', ts) + to_seconds(CAST(floor(value) AS BIGINT)) AS finished_at,
          CAST(json_extract_string(props, '$.k') AS BIGINT) AS rows,
          CASE WHEN event_type = 'error' THEN 'failed' END AS error_message FROM events""",
    ),
}


def sql(body: str, *needed: str) -> str:
    """``body`` preceded by the views it needs, and by the ones those need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for other in SQL[name][0]:
                add(other)
            ordered.append(name)

    for name in needed:
        add(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({SQL[name][1]})" for name in ordered) + "\n" + body
