"""Reading and exporting price rows."""

from __future__ import annotations

import csv
from datetime import date, datetime, timedelta
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.functions.dates import lenient_date
from barwright.functions.fingerprints import group_fingerprint
from barwright.functions.tickers import SUFFIX
from barwright.functions.values import encode_payload
from barwright.functions.paths import decoded_path
from barwright.schema import OHLC, PRICE_KEY, PRICES, Field, struct_type
from barwright.sources.files import (
    NO_VALUE,
    TASKS,
    WHOLE_BYTES,
    arrow_opens,
    few_listing_tasks,
    file_facts,
    glob_free,
    lines_of,
    listing_of,
    sharing_tasks,
    tasks_for,
    write_csv_folders,
)


def stored_form(ticker: str) -> str:
    """The base form in which tables hold a ticker."""
    return ticker.strip().upper().removesuffix(SUFFIX)


def _variants(ticker: str) -> list[str]:
    base = stored_form(ticker)
    return [base, base + SUFFIX]


def read_prices(
    prices: DataFrame,
    tickers: list[str] | str | None = None,
    start: date | str | None = None,
    end: date | str | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Rows of the named tickers, in base or suffixed form, between two dates, both included.

    Plain comparisons with literals, so they reach the file scan. Order at the sink with ``orderBy``.
    """
    found = prices
    if tickers is not None:
        wanted = [tickers] if isinstance(tickers, str) else tickers
        found = found.filter(F.col("ticker").isin(sorted({v for t in wanted for v in _variants(t)})))
    if start is not None:
        found = found.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        found = found.filter(F.col("date") <= F.lit(end).cast("date"))
    if columns is None:
        return found
    unknown = [c for c in columns if c not in prices.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}; got {prices.columns}")
    return found.select(*columns)


def last_days(prices: DataFrame, as_of: date, days: int) -> DataFrame:
    """The sample pull: rows of the last ``days`` days (one at least) up to ``as_of``."""
    low = as_of - timedelta(days=max(1, days))
    return read_prices(prices, start=low, end=as_of)


#: Columns that order the rows of files: time of the file, its path, place of the block in it, place of the row in the task.
INPUT_ORDER = ("_modified", "_path", "_block", "_row")


def input_order() -> dict[str, Column]:
    """All of :data:`INPUT_ORDER` but the row, which a stream can only number batch by batch."""
    return {
        "_modified": F.col("_metadata.file_modification_time"),
        "_path": decoded_path(F.col("_metadata.file_path")),
        "_block": F.col("_metadata.file_block_start"),
    }


#: Columns without which no row of a file can be keyed.
FILE_KEY = PRICE_KEY


def header_columns(header: str | None, needed: tuple[str, ...] = FILE_KEY) -> tuple[list[str], str | None]:
    """The column names of a header line, trimmed and in lower case, and why the file cannot be read, if so.

    >>> header_columns("date, Ticker,close"), header_columns("a,b")[1]
    ((['date', 'ticker', 'close'], None), 'header lacks ticker, date')
    """
    if header is None:
        return [], "header is no text"
    names = [c.strip().lower() for c in next(csv.reader([header]), [])]
    if missing := [c for c in needed if c not in names]:
        return names, f"header lacks {', '.join(missing)}"
    if repeated := sorted({c for c in names if names.count(c) > 1}):
        return names, f"header repeats {', '.join(repeated)}"
    return names, None


def header_groups(facts: DataFrame, needed: tuple[str, ...] = FILE_KEY) -> tuple[list[tuple[list[str], list[str]]], list[tuple[str, str]]]:
    """Files of ``path, header`` by their columns: (columns, paths) of the readable ones, (path, reason) of the others.

    The driver holds the paths that are to be read, as Spark's file listing does.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    refused = []
    for path, header in facts.select("path", "header").collect():
        columns, reason = header_columns(header, needed)
        if reason:
            refused.append((path, reason))
        else:
            groups.setdefault(tuple(columns), []).append(path)
    return [(list(columns), sorted(paths)) for columns, paths in sorted(groups.items())], sorted(refused)


def read_grouped_csv(spark: SparkSession, groups: list[tuple[list[str], list[str]]], fields: tuple[Field, ...] = PRICES) -> DataFrame:
    """Rows of CSV files as text, each group of files read once, by its own header.

    All declared columns and those of ``INPUT_ORDER`` are there; a column that a header lacks is null, and one that is not
    declared is left out. Lines that do not fit their header are kept in ``_corrupt``.
    """
    wanted = [f.name for f in fields]
    empty = T.StructType([T.StructField(c, T.StringType()) for c in (*wanted, "_corrupt")])
    frames = []
    for columns, paths in groups:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, "_corrupt")])
        reader = spark.read.schema(schema).option("columnPruning", "false")  # or short lines would pass
        with few_listing_tasks(spark):
            rows = reader.csv([glob_free(p) for p in paths], header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
        given = {c: F.col(c) if c in columns else F.lit(None).cast("string") for c in wanted}
        order = {**input_order(), "_row": F.monotonically_increasing_id()}
        frames.append(rows.select(*(v.alias(c) for c, v in given.items()), "_corrupt", *(v.alias(c) for c, v in order.items())))
    if not frames:
        none = spark.createDataFrame([], empty)
        return none.withColumns({c: F.lit(None).cast(t) for c, t in zip(INPUT_ORDER, ("timestamp", "string", "long", "long"), strict=True)})
    return reduce(DataFrame.unionByName, frames)


def headers_of(facts: DataFrame, needed: tuple[str, ...] = FILE_KEY) -> DataFrame:
    """``header, columns, reason`` of every header of ``facts``, which the driver reads once each, however many files share it."""
    found = [(r[0], *header_columns(r[0], needed)) for r in facts.select("header").distinct().collect()]
    columns = [pa.array(list(c), t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 3, (pa.string(), pa.list_(pa.string()), pa.string()), strict=True)]
    return facts.sparkSession.createDataFrame(pa.table(columns, ["header", "columns", "reason"]))  # rows of the plan, which need no job


def _struct_of(row: Column, held: list[str | None], names: tuple[str, ...]) -> Column:
    """A struct of the named fields of a row, null where ``held`` has none."""
    return F.struct(*((F.lit(None).cast("string") if h is None else row.getField(h)).alias(n) for h, n in zip(held, names, strict=True)))


def read_small_csv(files: DataFrame, fields: tuple[Field, ...] = PRICES, tasks: int = TASKS) -> DataFrame:
    """What :func:`read_grouped_csv` gives for files ``path, modified, columns``, opened by the tasks themselves.

    The lines are those that Spark's CSV source takes, and one parser a task and header reads them; a file costs no more than its bytes.
    """
    wanted = [f.name for f in fields]
    usable = sorted(tuple(r[0]) for r in files.select("columns").distinct().collect())
    parsed = F.lit(None)
    for columns in usable:
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in (*columns, "_corrupt"))
        row = F.from_csv("_line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "columnPruning": "false"})
        held = [c if c in (*columns, "_corrupt") else None for c in (*wanted, "_corrupt")]
        # the array keeps Spark from parsing a line once a column, each time for that column only, which finds no wrong lines
        one = F.get(F.transform(F.array(row), lambda r: _struct_of(r, held, (*wanted, "_corrupt"))), F.lit(0))
        parsed = F.when(F.col("columns") == F.array(*map(F.lit, columns)), one).otherwise(parsed)
    if not usable:
        parsed = F.struct(*(F.lit(None).cast("string").alias(c) for c in (*wanted, "_corrupt")))
    lines = lines_of(files.select("path", "modified", "columns"), tasks).withColumn("_parsed", parsed)
    return lines.select(
        "_parsed.*", F.col("modified").alias("_modified"), F.col("path").alias("_path"), F.lit(0).cast("long").alias("_block"), "_row"
    )


def read_csv_files(spark: SparkSession, folder: str, files: DataFrame, count: int, fields: tuple[Field, ...] = PRICES, needed: tuple[str, ...] = FILE_KEY) -> DataFrame:
    """The rows as text of ``count`` files ``path, size_bytes, modified, header, columns`` below a folder, as :func:`read_grouped_csv` gives them.

    Small files are opened by the tasks; only large ones, which Spark's CSV source splits, are named on the driver.
    """
    if not arrow_opens(folder):
        return read_grouped_csv(spark, header_groups(files, needed)[0], fields)
    small = F.col("size_bytes") <= WHOLE_BYTES
    rows = read_small_csv(files.filter(small), fields, tasks_for(count))
    large, _ = header_groups(files.filter(~small), needed)
    return rows.unionByName(read_grouped_csv(spark, large, fields)) if large else rows


def read_price_csv(
    spark: SparkSession, path: str | list[str], fields: tuple[Field, ...] = PRICES, typed: bool = False
) -> DataFrame:
    """Price rows of the ``*.csv`` files below a folder, as text (or typed), with the ``file`` each row came from.

    Every file is read by its own header, whose columns may stand in any order. Lines that do not fit are kept in
    ``_corrupt``; a file whose header cannot be used is one row, with the reason there. The columns of
    ``INPUT_ORDER`` say where a row stood: a later file, or a later line, is a later row.
    """
    groups, refused = header_groups(file_facts(spark, path, "*.csv").filter("size_bytes > 0"))
    raw = read_grouped_csv(spark, groups, fields)
    if refused:
        marks = spark.createDataFrame(refused, "_path string, _corrupt string")
        raw = raw.unionByName(marks, allowMissingColumns=True)
    raw = raw.withColumn("file", F.col("_path"))
    if not typed:
        return raw

    def value(f: Field) -> Column:
        text = F.col(f.name)
        return lenient_date(text) if f.kind == "date" else text.try_cast(f.spark_type)

    return raw.select(*(value(f).alias(f.name) for f in fields), "file")


def write_snapshot(prices: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """CSV files per ticker, sorted by date inside, with ISO dates and empty nulls.

    Rows are rebalanced by ticker: AQE packs short series together and splits a long one over several files.
    """
    rows = prices.select(F.col("ticker").alias("_ticker"), *sorted(prices.columns)).hint("rebalance", F.col("_ticker"))
    write_csv_folders(rows, path, ("_ticker",), ("date",), rows_per_file, dateFormat="yyyy-MM-dd")


def _snapshot_schema(fields: tuple[Field, ...]) -> T.StructType:
    return T.StructType(sorted(struct_type(fields).fields, key=lambda f: f.name))


def _snapshot_lines(files: DataFrame, fields: tuple[Field, ...], *keep: str) -> DataFrame:
    """The typed rows of files that :func:`write_snapshot` wrote, opened by the tasks, with the columns to ``keep``."""
    schema = _snapshot_schema(fields)
    row = F.from_csv("_line", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields))
    # the array keeps Spark from parsing a line once a column
    one = F.get(F.transform(F.array(row), lambda r: F.struct(*(r.getField(f.name).alias(f.name) for f in schema.fields))), F.lit(0))
    lines = lines_of(files.select("path", *keep), sharing_tasks(files.sparkSession)).withColumn("_parsed", one)
    return lines.select("_parsed.*", *keep)


def read_snapshot(spark: SparkSession, path: str, fields: tuple[Field, ...] = PRICES) -> DataFrame:
    """The rows of a folder that :func:`write_snapshot` wrote."""
    files = listing_of(spark, path, "*.csv")
    if files is not None:
        own = files.filter(F.regexp_replace("path", "/[^/]*$", "").rlike("/_ticker=[^/]*$"))
        return _snapshot_lines(own, fields).select(*(f.name for f in fields))
    return spark.read.schema(_snapshot_schema(fields)).csv(f"{path}/_ticker=*", header=True).select(*(f.name for f in fields))


def read_generations(spark: SparkSession, folders: list[str], fields: tuple[Field, ...] = PRICES, only: DataFrame | None = None) -> DataFrame:
    """The rows of several folders that :func:`write_snapshot` wrote, with ``_folder``, the ticker's folder of each row.

    Only the named folders are listed, and only the files of the ticker folders of ``only(_folder)`` are opened.
    """
    schema = T.StructType([*_snapshot_schema(fields).fields, T.StructField("_ticker", T.StringType())])
    frames = []
    for folder in folders:
        files = listing_of(spark, folder, "*.csv")
        named = F.concat(F.lit(f"{folder}/_ticker="), F.col("_ticker")).alias("_folder")
        if files is None:
            rows = spark.read.schema(schema).option("basePath", folder).csv(glob_free(folder), header=True).select("*", named)
            frames.append(rows if only is None else rows.join(only.select("_folder"), "_folder", "left_semi").select(*rows.columns))
            continue
        spelled = F.regexp_extract("path", "/_ticker=([^/]*)/[^/]*$", 1)
        ticker = F.coalesce(F.try_url_decode(F.replace(spelled, F.lit("+"), F.lit("%2B"))), spelled)
        files = files.filter(spelled != "").withColumn("_ticker", F.nullif(ticker, F.lit(NO_VALUE))).select("*", named)
        if only is not None:
            files = files.join(only.select("_folder"), "_folder", "left_semi").select(*files.columns)
        frames.append(_snapshot_lines(files, fields, "_ticker", "_folder"))
    if not frames:
        return spark.createDataFrame([], schema).withColumn("_folder", F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, frames)


#: Raw values keep their blanks, which a CSV writer would trim.
AS_GIVEN = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_raw_feed(feed: DataFrame, path: str, stamp: str, by: tuple[str, ...] = ("provider", "ticker")) -> None:
    """Add a raw feed below ``provider=/ticker=/ingest_ts=`` as CSV; the same pull again replaces its own folders."""
    (
        feed.withColumn("ingest_ts", F.lit(stamp))
        .hint("rebalance", *(F.col(c) for c in by))  # one writer per folder, more for a large one
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**AS_GIVEN)
        .partitionBy(*by, "ingest_ts")
        .csv(path, header=True)
    )


def raw_records(feed: DataFrame, job_id: str, at: datetime, by: tuple[str, ...] = ("provider", "ticker")) -> DataFrame:
    """One audit record per feed: rows and fingerprint of the raw values."""
    raw = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in feed.columns)), 256)
    return feed.groupBy(*by).agg(
        F.lit(job_id).alias("job_id"),
        F.lit(at).cast("timestamp").alias("fetched_at"),
        group_fingerprint(raw).alias("raw_checksum"),
        F.count("*").alias("rows"),
        F.lit("success").alias("status"),
    )


def export_csv(prices: DataFrame, path: str, **selection) -> None:
    """Write selected price rows as CSV, ranged and sorted by ticker and date over the output files."""
    read_prices(prices, **selection).orderBy("ticker", "date").write.option("dateFormat", "yyyy-MM-dd").csv(
        path, header=True
    )


def json_documents(snapshot: DataFrame, checksums: DataFrame) -> DataFrame:
    """One JSON document ``{ticker, checksum, rows, data}`` per ticker, as text.

    The snapshot is unique by (ticker, date), so a document has at most one entry per calendar day.
    """
    bar = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), *OHLC, "volume")
    documents = snapshot.groupBy("ticker").agg(
        F.count("*").alias("rows"), F.sort_array(F.collect_list(bar)).alias("data")
    )
    return documents.join(checksums.select("ticker", "checksum"), "ticker", "left").select(
        "ticker",
        encode_payload(
            ticker=F.col("ticker"), checksum=F.col("checksum"), rows=F.col("rows"), data=F.col("data")
        ).alias("value"),
    )


def export_json(snapshot: DataFrame, checksums: DataFrame, path: str) -> None:
    json_documents(snapshot, checksums).select("value").write.text(path)

