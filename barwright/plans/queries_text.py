"""Symbols, dates, names and flags held in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import dates, names, tickers, values
from barwright.plans import views
from barwright.plans.registry import query

BASE = "regexp_replace(upper(trim(t)), '\\.SA$', '')"
VALID = f"(regexp_matches({BASE}, '^[A-Z0-9]{{4,8}}$') AND regexp_matches({BASE}, '[0-9]'))"


@query(
    "ticker_forms",
    f"""SELECT DISTINCT t AS symbol, CASE WHEN {VALID} THEN {BASE} END AS base, CASE WHEN {VALID} THEN {BASE} || '.SA' END AS provider,
      {BASE} AS lenient, regexp_replace(upper(trim(replace(t, '.SA', ''))), '\\.SA$', '') AS returns_form,
      CASE WHEN regexp_matches(upper(trim(t)), '^[A-Z0-9]*[0-9]$') THEN upper(trim(t)) || '.SA' ELSE upper(trim(t)) END AS feed_form,
      CASE WHEN {VALID} THEN {BASE} || ',' || {BASE} || '.SA' END AS variants FROM (SELECT ticker AS t FROM raw_quotes)""",
    ("raw_quotes",),
)
def ticker_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = F.col("symbol")
    symbols = views.raw_quotes(spark, sf_dir).select(F.col("Ticker").alias("symbol")).distinct()
    return symbols.select(
        "symbol",
        tickers.normalize_ticker(symbol).alias("base"),
        tickers.provider_ticker(symbol).alias("provider"),
        tickers.lenient_ticker(symbol).alias("lenient"),
        tickers.returns_ticker(symbol).alias("returns_form"),
        tickers.feed_ticker(symbol).alias("feed_form"),
        F.array_join(tickers.ticker_variants(symbol), ",").alias("variants"),
    )


@query(
    "ticker_lists",
    """SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 4 = 0 THEN ['PETR4', 'VALE3'] ELSE
      ['S' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0'), 'N' || lpad(CAST(s_nationkey AS VARCHAR), 5, '0')] END) AS ticker
      FROM supplier""",
)
def ticker_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = views.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey",
        "CASE WHEN s_suppkey % 4 = 0 THEN concat('??, ', s_name, ',') ELSE concat('S', lpad(cast(s_suppkey as string), 7, '0'), "
        "' , n', lpad(cast(s_nationkey as string), 5, '0'), '.sa,bad!,') END AS list",
    )
    return tickers.split_ticker_list(lists, "list", ("PETR4", "VALE3")).select("s_suppkey", "ticker")


@query(
    "date_forms",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS strict,
      CASE WHEN o_orderkey % 4 IN (0, 1) THEN CAST(o_orderdate AS DATE) END AS feed,
      CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, ' %m-%d-%Y').trim()
        WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T23:30:00-05:00' END AS dashed,
      CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 3 THEN CAST(o_orderdate AS DATE) + 1 END AS lenient,
      strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS stamp,
      CAST(o_orderdate + INTERVAL 5 HOUR AS DATE) AS utc_day FROM orders""",
)
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = views.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "cast(o_orderdate as timestamp) AS at",
        "CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, ' MM-dd-yyyy') "
        "WHEN 2 THEN date_format(o_orderdate, 'yyyyMMdd') ELSE concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T23:30:00-05:00') "
        "END AS text",
    )
    return rows.select(
        "o_orderkey",
        dates.strict_iso_date(text).alias("strict"),
        dates.feed_date(text).alias("feed"),
        dates.dashed_date(text).alias("dashed"),
        dates.lenient_date(text).alias("lenient"),
        dates.compact_stamp(F.col("at")).alias("stamp"),
        dates.utc_date(F.col("at"), "-05:00").alias("utc_day"),
    )


PATH_DATES = r"regexp_extract_all(coalesce(snapshot_path, ''), '(\d{4}-\d{2}-\d{2}|\d{8})', 1)"
START = f"coalesce(json_start, {PATH_DATES}[1], '')"
END = f"coalesce(json_end, {PATH_DATES}[2], '')"
RANGE_SQL = f"""SELECT id, ticker, regexp_replace({START}, '^(\\d{{4}})(\\d{{2}})(\\d{{2}})$', '\\1-\\2-\\3') AS start,
    regexp_replace({END}, '^(\\d{{4}})(\\d{{2}})(\\d{{2}})$', '\\1-\\2-\\3') AS "end" FROM (SELECT *,
    CASE WHEN starts_with(payload, '{{') THEN coalesce(json_extract_string(payload, '$.start'),
      json_extract_string(payload, '$.start_date')) END AS json_start,
    CASE WHEN starts_with(payload, '{{') THEN json_extract_string(payload, '$.end_date') END AS json_end FROM catalog)"""


@query(
    "snapshot_ranges",
    f"""SELECT id, start, "end", sha256(ticker || '_' || start || '_' || "end") AS stable_id FROM ({RANGE_SQL})""",
    ("catalog",),
)
def snapshot_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload, path = F.col("payload"), F.col("snapshot_path")
    start, end = dates.snapshot_range(payload, path)
    stable = names.stable_snapshot_id(F.col("ticker"), payload, path)
    return views.catalog(spark, sf_dir).select("id", start.alias("start"), end.alias("end"), stable.alias("stable_id"))


@query(
    "snapshot_names",
    r"""SELECT id, name, CASE WHEN ok THEN regexp_extract(name, '^([A-Z0-9]+(\.[A-Z0-9]+)?)-', 1) END AS ticker,
      CASE WHEN ok THEN regexp_extract(name, '-(\d{8}T\d{6})', 1) END AS stamp,
      CASE WHEN ok THEN regexp_extract(name, 'T\d{6}Z?-([^.]+)\.csv$', 1) END AS suffix,
      CASE WHEN starts_with(path, '/tmp/') THEN name ELSE path END AS stored, replace(name, '/', '_') AS token,
      replace(name, '.', '_') AS dotless FROM (
      SELECT id, snapshot_path AS path, parse_filename(snapshot_path) AS name,
        regexp_matches(parse_filename(snapshot_path), '^[A-Z0-9]+(\.[A-Z0-9]+)?-\d{8}T\d{6}Z?(-[^.]+)?\.csv$') AS ok
      FROM catalog WHERE snapshot_path IS NOT NULL)""",
    ("catalog",),
)
def snapshot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, name = F.col("snapshot_path"), F.col("name")
    rows = views.catalog(spark, sf_dir).filter("snapshot_path IS NOT NULL").withColumn("name", names.basename(path))
    parts = names.snapshot_name_parts(name)
    return rows.select(
        "id",
        "name",
        parts["ticker"].alias("ticker"),
        F.date_format(parts["stamp"], "yyyyMMdd'T'HHmmss").alias("stamp"),
        parts["suffix"].alias("suffix"),
        names.stored_path(path).alias("stored"),
        names.safe_token(name).alias("token"),
        names.safe_token(name, keep_dot=False).alias("dotless"),
    )


@query(
    "flags_and_thresholds",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS strict, o_orderstatus = 'O' AS lenient,
      CASE o_orderpriority WHEN '1-URGENT' THEN 0.25 WHEN '2-HIGH' THEN 0.4 WHEN '3-MEDIUM' THEN 0.05 ELSE 0.1 END AS threshold
      FROM orders""",
)
def flags_and_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("o_orderstatus") == "O", " Yes").when(F.col("o_orderstatus") == "F", "OFF ").otherwise(
        F.col("o_orderpriority")
    )
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "25%")
        .when(F.col("o_orderpriority") == "2-HIGH", " 40 ")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "0.05")
        .when(F.col("o_orderpriority") == "5-LOW", "-3")
        .otherwise(F.col("o_orderpriority"))
    )
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        values.strict_flag(flag).alias("strict"),
        values.lenient_flag(flag).alias("lenient"),
        values.threshold_column(text).alias("threshold"),
    )


@query(
    "payloads",
    """SELECT id, CASE WHEN starts_with(payload, '{') THEN json_extract_string(payload, '$.start') END AS start,
      '{"ticker":"' || ticker || '","rows":' || rows || CASE WHEN checksum IS NULL THEN '' ELSE ',"checksum":"' || checksum || '"' END
      || '}' AS encoded FROM catalog""",
    ("catalog",),
)
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = values.encode_payload(ticker=F.col("ticker"), rows=F.col("rows"), checksum=F.col("checksum"))
    return views.catalog(spark, sf_dir).select(
        "id", values.decode_payload(F.col("payload"))["start"].alias("start"), encoded.alias("encoded")
    )


@query(
    "zoned_stamps",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(date_trunc('second', ts), '%Y%m%dT%H%M%SZ')
      WHEN 1 THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y%m%dT%H%M%SZ') END AS stamp FROM events""",
)
def zoned_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with a zone become stamps; times without one are refused."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+02:00").otherwise("")
    return views.table(spark, sf_dir, "events").select("event_id", dates.zoned_stamp(F.concat(text, zone)).alias("stamp"))
