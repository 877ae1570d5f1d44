"""Mapping, quality rules, quarantine and the gate."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions.tickers import lenient_ticker
from barwright.operators.ingest import pull_sample, save_sample
from barwright.operators.mapping import (
    NUMBERED_FEED,
    ProviderMapping,
    explode_series,
    flatten_labels,
    mapping_verdicts,
    register_provider,
    to_canonical,
)
from barwright.operators.quality import (
    annotate,
    check_metadata,
    coerce,
    error_code_counts,
    error_details,
    gate,
    handle,
    invalid_rows,
    reason_code,
    summarize,
    valid_rows,
    validation_events,
)
from barwright.operators.quality import quarantined_rows as read_quarantine
from barwright.plans import views
from barwright.plans.registry import query
from barwright.schema import PRICES, Field
from barwright.session import scratch_dir

ERRORS_SQL = """SELECT feed_row, provider, ticker, 'date' AS "column", 'BAD_DATE' AS reason_code, raw_date AS failure_value
    FROM typed WHERE raw_date IS NOT NULL AND date IS NULL
  UNION ALL SELECT feed_row, provider, ticker, 'open', 'NON_NUMERIC_PRICE', raw_open FROM typed
    WHERE raw_open IS NOT NULL AND open IS NULL
  UNION ALL SELECT feed_row, provider, ticker, 'volume', 'NON_NUMERIC_VOLUME', raw_volume FROM typed
    WHERE raw_volume IS NOT NULL AND volume IS NULL
  UNION ALL SELECT feed_row, provider, ticker, 'source', 'VALIDATION_ERROR', NULL FROM typed WHERE source IS NULL
  UNION ALL SELECT feed_row, provider, ticker, 'high,low', 'CONSTRAINT_VIOLATION', NULL FROM typed WHERE high < low"""
BAD_SQL = f"SELECT DISTINCT feed_row FROM ({ERRORS_SQL})"


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(views.quotes(spark, sf_dir))


@query(
    "canonical_rows",
    """SELECT ticker, coalesce(TRY_CAST(date AS DATE), CAST(TRY_STRPTIME(date, '%m-%d-%Y') AS DATE)) AS date,
      TRY_CAST(open AS DOUBLE) AS open, TRY_CAST(high AS DOUBLE) AS high, TRY_CAST(low AS DOUBLE) AS low,
      TRY_CAST(close AS DOUBLE) AS close,
      CASE WHEN TRY_CAST(volume AS DOUBLE) = floor(TRY_CAST(volume AS DOUBLE))
        THEN CAST(TRY_CAST(volume AS DOUBLE) AS BIGINT) END AS volume,
      provider AS source, '2024-01-31 00:00:00' AS fetched_at, feed_row FROM raw_quotes""",
    ("raw_quotes",),
)
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = to_canonical(
        views.raw_quotes(spark, sf_dir), F.col("provider"), fetched_at=views.FETCHED, keep=("feed_row",)
    )
    return mapped.drop("raw_checksum").withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "mapping_verdicts",
    """SELECT provider AS source, ticker, count(*) AS rows,
      count(*) FILTER (WHERE NOT coalesce(h > l OR (h = 0 AND l = 0), true) OR d IS NULL OR ticker IS NULL) AS broken_rows,
      count(*) FILTER (WHERE NOT coalesce(h > l OR (h = 0 AND l = 0), true) OR d IS NULL OR ticker IS NULL) = 0 AS mapped
      FROM (SELECT *, TRY_CAST(high AS DOUBLE) AS h, TRY_CAST(low AS DOUBLE) AS l,
        coalesce(TRY_CAST(date AS DATE), CAST(TRY_STRPTIME(date, '%m-%d-%Y') AS DATE)) AS d FROM raw_quotes)
      GROUP BY provider, ticker""",
    ("raw_quotes",),
)
def query_mapping_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.raw_quotes(spark, sf_dir)
    return mapping_verdicts(to_canonical(raw, F.col("provider"), fetched_at=views.FETCHED))


@query(
    "numbered_feed_rows",
    "SELECT ticker, date, open, high, low, close, volume, 'numbered' AS source FROM bars",
    ("bars",),
)
def numbered_feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text(name: str):
        return F.col(name).cast("decimal(18,4)").cast("string")

    labels = {"1. open": "open", "2. high": "high", "3. low": "low", "4. close": "close"}
    pairs = [x for label, name in labels.items() for x in (F.lit(label), text(name))]
    values = F.create_map(*pairs, F.lit("6. volume"), F.col("volume").cast("string"))
    day = F.struct(F.date_format("date", "yyyy-MM-dd").alias("key"), values.alias("value"))
    documents = (
        views.bars(spark, sf_dir)
        .groupBy("ticker", F.year("date").alias("year"))  # a year of a ticker is one provider answer
        .agg(F.map_from_entries(F.collect_list(day)).alias("Time Series (Daily)"))
        .select(
            F.to_json(
                F.struct(F.struct(F.col("ticker").alias("2. Symbol")).alias("Meta Data"), "Time Series (Daily)")
            ).alias("answer")
        )
    )
    rows = explode_series(documents, "answer", "Time Series (Daily)", "$['Meta Data']['2. Symbol']")
    mapped = to_canonical(rows, "numbered", fetched_at=views.FETCHED, mapping=NUMBERED_FEED)
    return mapped.drop("fetched_at", "raw_checksum")


@query(
    "coerced_columns",
    "SELECT feed_row, date, open, high, low, close, volume FROM typed",
    ("typed",),
)
def coerced_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coerce(views.quotes(spark, sf_dir)).select("feed_row", "date", "open", "high", "low", "close", "volume")


@query(
    "row_errors",
    f"""SELECT feed_row, "column", reason_code, failure_value FROM ({ERRORS_SQL})""",
    ("typed",),
)
def row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = error_details(checked(spark, sf_dir), ("feed_row",))
    shown = F.when(F.col("column") != "high,low", F.col("failure_value"))
    return details.select("feed_row", "column", "reason_code", shown.alias("failure_value"))


@query(
    "strict_row_errors",
    """SELECT feed_row, date, high, low FROM typed
      WHERE high IS NOT NULL AND low IS NOT NULL AND NOT (high > low OR (high = 0 AND low = 0))""",
    ("typed",),
)
def strict_row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = annotate(views.quotes(spark, sf_dir), strict=True)
    broken = F.exists("errors", lambda e: e["reason_code"] == "CONSTRAINT_VIOLATION")
    return bad.filter(broken).select("feed_row", "date", "high", "low")


@query(
    "negative_volumes",
    "SELECT feed_row, CAST(volume AS VARCHAR) AS failure_value FROM typed WHERE volume < 0",
    ("typed",),
)
def negative_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = error_details(annotate(views.quotes(spark, sf_dir), negative_volume=True), ("feed_row",))
    return details.filter("reason_code = 'NEGATIVE_VOLUME'").select("feed_row", "failure_value")


@query(
    "missing_column_rows",
    "SELECT reason_code, count(*) AS errors FROM (SELECT 'MISSING_COL' AS reason_code FROM quotes) GROUP BY ALL",
    ("quotes",),
)
def missing_column_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_code_counts(annotate(views.quotes(spark, sf_dir).drop("ticker")))


@query(
    "valid_quotes",
    f"""SELECT ticker, date, open, high, low, close, volume, source, feed_row FROM typed
      WHERE feed_row NOT IN ({BAD_SQL})""",
    ("typed",),
)
def valid_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_rows(checked(spark, sf_dir)).drop("fetched_at", "raw_checksum", "provider", "seq")


@query(
    "invalid_quotes",
    f"""SELECT feed_row, count(*) AS errors FROM ({ERRORS_SQL}) GROUP BY feed_row""",
    ("typed",),
)
def invalid_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_rows(checked(spark, sf_dir)).select("feed_row", F.size("errors").cast("long").alias("errors"))


@query(
    "quality_summary",
    f"""SELECT (SELECT count(*) FROM typed) AS rows_total, (SELECT count(*) FROM typed) - count(*) AS rows_valid,
      count(*) AS rows_invalid, round(count(*) / CAST((SELECT count(*) FROM typed) AS DOUBLE), 8) AS invalid_share
      FROM ({BAD_SQL})""",
    ("typed",),
)
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = summarize(checked(spark, sf_dir))
    return totals.withColumn("invalid_share", F.round("invalid_share", 8)).drop("error_codes")


@query(
    "error_code_counts",
    f"SELECT reason_code, count(*) AS errors FROM ({ERRORS_SQL}) GROUP BY reason_code",
    ("typed",),
)
def query_error_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_code_counts(checked(spark, sf_dir))


@query(
    "error_codes_by_provider",
    f"SELECT provider, reason_code, count(*) AS errors FROM ({ERRORS_SQL}) GROUP BY provider, reason_code",
    ("typed",),
)
def error_codes_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_provider = summarize(checked(spark, sf_dir), ("provider",))
    return per_provider.select("provider", F.explode("error_codes").alias("reason_code", "errors"))


@query(
    "quality_gate",
    f"""SELECT provider, ticker, rows_total, rows_invalid, threshold,
      CAST(rows_invalid AS DOUBLE) / rows_total < threshold AS passed FROM (
      SELECT provider, ticker, count(*) AS rows_total, count(*) FILTER (WHERE feed_row IN ({BAD_SQL})) AS rows_invalid,
        CASE provider WHEN 'alpha' THEN CAST(5 AS DOUBLE) / 100 ELSE CAST('0.1' AS DOUBLE) END AS threshold
      FROM typed GROUP BY provider, ticker)""",
    ("typed",),
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checked(spark, sf_dir)
    names = rows.select("provider").distinct()
    text = F.when(F.col("provider") == "alpha", "5%").otherwise("250")  # 250 is out of range: the default holds
    verdicts = gate(rows, ("provider", "ticker"), names.withColumn("threshold", text))
    return verdicts.select("provider", "ticker", "rows_total", "rows_invalid", "threshold", "passed")


@query(
    "validation_events",
    f"""SELECT provider, ticker, count(DISTINCT feed_row) AS invalid_count, count(*) AS errors
      FROM ({ERRORS_SQL}) GROUP BY provider, ticker""",
    ("typed",),
)
def query_validation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = validation_events(checked(spark, sf_dir), ("provider", "ticker"), ("feed_row",), details_per_event=20)
    errors = F.aggregate("error_details", F.lit(0).cast("long"), lambda n, d: n + F.size(d["errors"]))
    return events.groupBy("provider", "ticker", "invalid_count").agg(F.sum(errors).alias("errors"))


@query(
    "checked_feed",
    f"""SELECT ticker, date, open, high, low, close, volume, source, feed_row, true AS passed FROM typed
      WHERE feed_row NOT IN ({BAD_SQL})""",
    ("typed",),
)
def checked_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "checked") + "/run"
    feed = views.quotes(spark, sf_dir).withColumn("ticker_dir", F.col("ticker"))
    valid, passed = handle(spark, feed, folder, by=("provider", "ticker_dir"), id_columns=("feed_row",), abort=False)
    return valid.select(
        "ticker", "date", "open", "high", "low", "close", "volume", "source", "feed_row", F.lit(passed).alias("passed")
    )


@query(
    "quarantined_rows",
    f"""SELECT q.provider, q.feed_row, CAST(t.date AS VARCHAR) AS date, t.volume FROM quotes q JOIN typed t
      ON q.feed_row = t.feed_row WHERE q.feed_row IN ({BAD_SQL})""",
    ("typed",),
)
def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "quarantine") + "/run"
    feed = views.quotes(spark, sf_dir)
    handle(spark, feed, folder, by=("provider",), id_columns=("feed_row",), abort=False)
    kept = read_quarantine(spark, folder, feed.columns)
    return kept.select("provider", "feed_row", "date", F.col("volume").cast("bigint").alias("volume"))


@query(
    "feed_of_nested_labels",
    """SELECT upper(replace(trim(ticker), '.sa', '')) AS ticker, coalesce(TRY_CAST(date AS DATE), CAST(TRY_STRPTIME(date, '%m-%d-%Y') AS DATE)) AS date,
      TRY_CAST(close AS DOUBLE) AS close, CAST(NULL AS DOUBLE) AS adj_close, 'nested' AS source, feed_row FROM raw_quotes WHERE ticker <> '??'""",
    ("raw_quotes",),
)
def feed_of_nested_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider of its own labels, in two levels, whose optional adjusted close is missing."""
    raw = views.raw_quotes(spark, sf_dir).filter("Ticker != '??'")
    labels = {"Open": "o", "High": "h", "Low": "l", "Close": "last price", "Volume": "traded"}
    nested = raw.select("Ticker", "Date", "feed_row", *(F.struct(F.col(c).alias("X")).alias(label) for c, label in labels.items()))
    register_provider(ProviderMapping("nested", {c.lower(): (label,) for c, label in labels.items()}))
    fields = (*PRICES, Field("adj_close", "float"))
    mapped = to_canonical(flatten_labels(nested), "nested", lenient_ticker(F.col("Ticker")), views.FETCHED, fields=fields, keep=("feed_row",))
    return mapped.select("ticker", "date", "close", "adj_close", "source", "feed_row")


@query(
    "sample_pull_files",
    """SELECT feed_row, r.close AS raw_close, c.ticker, c.date, c.close, c.volume FROM (SELECT *,
        coalesce(TRY_CAST(date AS DATE), CAST(TRY_STRPTIME(date, '%m-%d-%Y') AS DATE)) AS d FROM raw_quotes) r
      JOIN (SELECT feed_row, ticker, coalesce(TRY_CAST(date AS DATE), CAST(TRY_STRPTIME(date, '%m-%d-%Y') AS DATE)) AS date,
        TRY_CAST(close AS DOUBLE) AS close, CASE WHEN TRY_CAST(volume AS DOUBLE) = floor(TRY_CAST(volume AS DOUBLE))
        THEN CAST(TRY_CAST(volume AS DOUBLE) AS BIGINT) END AS volume FROM raw_quotes) c USING (feed_row)
      WHERE d BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'""",
    ("raw_quotes",),
)
def sample_pull_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of a raw feed and of its canonical rows, each in files of its own, read back and put side by side."""
    folder = scratch_dir(spark, "sample")
    feed = views.raw_quotes(spark, sf_dir)
    raw, canonical = pull_sample(feed, F.col("provider"), date(1997, 3, 31), start="1997-03-01", end="1997-03-31", fetched_at=views.FETCHED)
    save_sample(raw, canonical, folder)
    texts = spark.read.schema(", ".join(f"`{c}` string" for c in feed.columns)).csv(f"{folder}/raw", header=True)
    rows = spark.read.schema(canonical.schema).csv(f"{folder}/canonical", header=True)
    # the canonical checksum is that of the raw values
    values = F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in feed.columns))
    texts = texts.select("feed_row", F.col("Close").alias("raw_close"), F.sha2(values, 256).alias("raw_checksum"))
    return texts.join(rows, "raw_checksum").select("feed_row", "raw_close", "ticker", "date", "close", "volume")


@query(
    "reason_codes_of_messages",
    """SELECT doc_id, CASE
      WHEN contains(m, 'column') AND (contains(m, 'not in') OR contains(m, 'missing')) THEN 'MISSING_COL'
      WHEN contains(c, 'date') AND (contains(m, 'type') OR contains(m, 'datetime')) THEN 'BAD_DATE'
      WHEN c IN ('open', 'high', 'low', 'close') AND (contains(m, 'float') OR contains(m, 'numeric')) THEN 'NON_NUMERIC_PRICE'
      WHEN c = 'volume' AND (contains(m, 'negative') OR contains(m, '< 0')) THEN 'NEGATIVE_VOLUME'
      WHEN c = 'volume' AND (contains(m, 'int') OR contains(m, 'numeric')) THEN 'NON_NUMERIC_VOLUME'
      WHEN contains(m, 'float') OR contains(m, 'int') OR contains(m, 'coerce') THEN 'TYPE_ERROR'
      WHEN contains(m, 'check') OR contains(m, 'constraint') THEN 'CONSTRAINT_VIOLATION'
      ELSE 'VALIDATION_ERROR' END AS reason_code FROM (
      SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'close' WHEN 2 THEN 'volume' ELSE 'ticker' END AS c,
        lower(CASE doc_id % 5 WHEN 0 THEN 'Column missing: ' WHEN 1 THEN 'bad type: ' WHEN 2 THEN 'not numeric: '
          WHEN 3 THEN 'value < 0: ' ELSE '' END || text) AS m FROM documents)""",
)
def reason_codes_of_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = views.table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "CASE doc_id % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'close' WHEN 2 THEN 'volume' ELSE 'ticker' END AS name",
        "concat(CASE doc_id % 5 WHEN 0 THEN 'Column missing: ' WHEN 1 THEN 'bad type: ' WHEN 2 THEN 'not numeric: ' "
        "WHEN 3 THEN 'value < 0: ' ELSE '' END, text) AS message",
    )
    return messages.select("doc_id", reason_code(F.col("message"), F.col("name")).alias("reason_code"))


@query(
    "metadata_contract",
    """SELECT id, CASE WHEN n % 9 = 4 THEN 1 ELSE 0 END + CASE WHEN n % 9 = 5 THEN 1 ELSE 0 END
        + CASE WHEN n % 9 IN (1, 2, 3, 6, 7, 8) THEN 1 ELSE 0 END
        + CASE WHEN checksum IS NULL AND n % 9 <> 8 THEN 1 ELSE 0 END AS problems
      FROM (SELECT id, checksum, CAST(substr(id, 6) AS BIGINT) AS n FROM catalog)""",
    ("catalog",),
)
def metadata_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.catalog(spark, sf_dir).withColumn("n", F.expr("cast(substr(id, 6) as bigint) % 9"))
    document = F.to_json(
        F.struct(
            F.when(F.col("n") != 1, F.col("ticker")).alias("ticker"),
            F.when(F.col("n") == 2, F.lit("01/02/2024"))
            .when(F.col("n") == 3, F.lit("2023-02-31"))
            .otherwise(F.date_format("created_at", "yyyy-MM-dd"))
            .alias("snapshot_date"),
            F.when(F.col("n") == 4, -F.col("rows") - 1).otherwise(F.col("rows")).alias("rows"),
            "checksum",
            F.when(F.col("n") == 5, F.lit("1.0")).otherwise(F.lit("1.0.0")).alias("schema_version"),
            F.lit("desk").alias("source"),
            F.when(F.col("n") == 6, F.lit("x")).alias("surprise"),
        )
    )
    text = F.when(F.col("n") == 8, F.lit("{not json")).otherwise(document)
    # rows as text breaks the type rule
    typed = F.when(F.col("n") == 7, F.regexp_replace(text, r'"rows":(\d+)', '"rows":"$1"')).otherwise(text)
    problems = check_metadata(rows.select("id", typed.alias("document")), "document")
    return problems.select("id", F.size("problems").alias("problems"))
