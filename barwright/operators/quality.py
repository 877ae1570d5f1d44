"""Row rules, quarantine and the threshold gate.

Every rule runs on every row inside one projection; a row carries its errors as an array. Counts combine on
the map side, so no rule, provider or ticker however common gathers its rows in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.functions.dates import lenient_date
from barwright.functions.values import DEFAULT_THRESHOLD, threshold_column
from barwright.operators.mapping import MappingError, missing_feed_columns, quoted, strict_high_low, to_count, to_number
from barwright.schema import ERROR_TYPE, OHLC, PRICES, Field, names, required
from barwright.session import scratch_dir

# The reason codes.
MISSING_COL = "MISSING_COL"
BAD_DATE = "BAD_DATE"
NON_NUMERIC_PRICE = "NON_NUMERIC_PRICE"
NEGATIVE_VOLUME = "NEGATIVE_VOLUME"
NON_NUMERIC_VOLUME = "NON_NUMERIC_VOLUME"
TYPE_ERROR = "TYPE_ERROR"
CONSTRAINT_VIOLATION = "CONSTRAINT_VIOLATION"
VALIDATION_ERROR = "VALIDATION_ERROR"
MALFORMED_LINE = "MALFORMED_LINE"  # our own: a line of a file that does not fit its header
REASON_CODES = (
    MISSING_COL,
    BAD_DATE,
    NON_NUMERIC_PRICE,
    NEGATIVE_VOLUME,
    NON_NUMERIC_VOLUME,
    TYPE_ERROR,
    CONSTRAINT_VIOLATION,
    VALIDATION_ERROR,
)


#: Folders of kept invalid rows.
QUARANTINE_BUCKETS = 64


class ThresholdExceeded(ValueError):
    """The share of invalid rows reached the threshold."""


@dataclass(frozen=True)
class Rule:
    """``broken`` says when a row breaks the rule; ``value`` is the text to report."""

    column: str | None
    code: str
    message: str
    broken: Column
    value: Column

    @property
    def hits(self) -> Column:
        return F.coalesce(self.broken, F.lit(False))

    def as_error(self) -> Column:
        error = F.struct(
            F.lit(self.column).alias("column"),
            F.lit(self.code).alias("reason_code"),
            F.lit(self.message).alias("reason_message"),
            self.value.cast("string").alias("failure_value"),
        )
        return F.when(self.hits, error)


#: How the text of each checked column becomes a value.
COERCED = {"date": lenient_date, **{name: to_number for name in OHLC}, "volume": to_count}


def coerce(df: DataFrame) -> DataFrame:
    """Typed date, prices and volume; what does not parse becomes null."""
    return df.withColumns({name: make(F.col(name).cast("string")) for name, make in COERCED.items() if name in df.columns})


def high_low_rule(strict: bool = False) -> Rule:
    """Lenient: only ``high < low`` is wrong. Strict: the mapping rule, which also refuses flat bars."""
    high, low = F.col("high"), F.col("low")
    shown = F.concat_ws(",", F.concat(F.lit("high="), high), F.concat(F.lit("low="), low))
    broken = ~strict_high_low(high, low) if strict else high < low
    return Rule("high,low", CONSTRAINT_VIOLATION, "high is below low", broken, shown)


def price_rules(
    df: DataFrame, fields: tuple[Field, ...] = PRICES, strict: bool = False, negative_volume: bool = False
) -> list[Rule]:
    """The rules for a frame prepared by :func:`annotate`: typed columns, raw text under ``_raw``."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    rules = []

    def unparsed(column: str, code: str, message: str) -> None:
        if column in text:
            raw = F.col("_raw")[column]
            given = raw.isNotNull() & ~F.lower(F.trim(raw)).isin("", "nan")
            rules.append(Rule(column, code, message, F.col(column).isNull() & given, raw))

    unparsed("date", BAD_DATE, "date does not parse")
    for column in OHLC:
        unparsed(column, NON_NUMERIC_PRICE, "price is not a number")
    unparsed("volume", NON_NUMERIC_VOLUME, "volume is not a whole number")
    for column in required(fields):
        empty = F.col(column).isNull()
        if column == "date" and column in text:
            raw = F.col("_raw")[column]
            empty = empty & (raw.isNull() | F.lower(F.trim(raw)).isin("", "nan"))
        rules.append(
            Rule(column, VALIDATION_ERROR, "value must not be null", empty, F.lit(None).cast("string"))
        )
    rules.append(high_low_rule(strict))
    if negative_volume:
        rules.append(Rule("volume", NEGATIVE_VOLUME, "volume is negative", F.col("volume") < 0, F.col("volume")))
    return rules


def annotate(
    df: DataFrame,
    fields: tuple[Field, ...] = PRICES,
    strict: bool = False,
    negative_volume: bool = False,
    extra_rules: tuple[Rule, ...] = (),
) -> DataFrame:
    """Typed rows with an ``errors`` array, empty for a valid row; extra columns are kept.

    When a declared column is missing from the frame, every row is invalid with ``MISSING_COL``.
    """
    missing = [name for name in names(fields) if name not in df.columns]
    if missing:
        error = F.struct(
            F.lit(None).cast("string").alias("column"),
            F.lit(MISSING_COL).alias("reason_code"),
            F.lit(f"missing columns: {', '.join(missing)}").alias("reason_message"),
            F.lit(None).cast("string").alias("failure_value"),
        )
        return coerce(df).withColumn("errors", F.array(error).cast(f"array<{ERROR_TYPE}>"))
    rules = [*price_rules(df, fields, strict, negative_volume), *extra_rules]
    checked = ("date", *OHLC, "volume")
    broken = reduce(or_, (rule.hits for rule in rules))
    errors = F.when(broken, F.array_compact(F.array(*(rule.as_error() for rule in rules)))).otherwise(F.array().cast(f"array<{ERROR_TYPE}>"))
    # Generators of one row each: a filter on the errors stays above them. Below, it would spell out every rule down to the source's
    # own expressions, once for each mention of a column, and compute all of that for every row.
    raw = F.struct(*(F.col(c).cast("string").alias(c) for c in checked))
    given = df.select("*", F.explode(F.array(raw)).alias("_raw"))
    typed = F.explode(F.array(F.struct(*(make(F.col("_raw")[c]).alias(c) for c, make in COERCED.items())))).alias("_typed")
    columns = [F.col("_typed")[c].alias(c) if c in checked else quoted(c) for c in df.columns]
    checked_rows = given.select("*", typed).select(*columns, "_raw")
    return checked_rows.select("*", F.explode(F.array(errors)).alias("errors")).drop("_raw")


def valid_rows(annotated: DataFrame) -> DataFrame:
    return annotated.filter(F.size("errors") == 0).drop("errors")


def invalid_rows(annotated: DataFrame) -> DataFrame:
    return annotated.filter(F.size("errors") > 0)


def summarize(annotated: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals, the invalid share and the count per reason code, in one aggregation.

    An empty frame gives one row of zeros when there is no grouping.
    """
    bad = F.size("errors") > 0

    def errors_with(code: str) -> Column:
        return F.coalesce(
            F.sum(F.size(F.filter("errors", lambda e: e["reason_code"] == code)).cast("long")), F.lit(0)
        )

    counted = annotated.groupBy(*by).agg(
        F.count("*").alias("rows_total"),
        F.count_if(~bad).alias("rows_valid"),
        F.count_if(bad).alias("rows_invalid"),
        *(errors_with(code).alias(f"_{code}") for code in REASON_CODES),
    )
    codes = F.map_from_arrays(
        F.array(*(F.lit(c) for c in REASON_CODES)), F.array(*(F.col(f"_{c}") for c in REASON_CODES))
    )
    return counted.select(
        *by,
        "rows_total",
        "rows_valid",
        "rows_invalid",
        F.coalesce(F.try_divide("rows_invalid", "rows_total"), F.lit(0.0)).alias("invalid_share"),
        F.map_filter(codes, lambda _, n: n > 0).alias("error_codes"),
    )


def error_code_counts(annotated: DataFrame) -> DataFrame:
    """Errors per reason code, as rows."""
    return (
        annotated.select(F.explode("errors.reason_code").alias("reason_code"))
        .groupBy("reason_code")
        .agg(F.count("*").alias("errors"))
    )


def error_details(annotated: DataFrame, id_columns: tuple[str, ...]) -> DataFrame:
    """One row per error, with the columns that identify its row."""
    return annotated.select(*id_columns, F.explode("errors").alias("_error")).select(*id_columns, "_error.*")


def check_threshold(summary: DataFrame, threshold: float = DEFAULT_THRESHOLD, abort: bool = True) -> bool:
    """The gate over a whole frame: fails when the invalid share reaches the threshold."""
    row = summary.first()
    if row["invalid_share"] < threshold:
        return True
    if abort:
        raise ThresholdExceeded(
            f"{row['rows_invalid']} of {row['rows_total']} rows invalid "
            f"({row['invalid_share']:.1%}, threshold {threshold:.1%}): {row['error_codes']}"
        )
    return False


def gate(
    annotated: DataFrame, by: tuple[str, ...], thresholds: DataFrame | None = None, on: str = "provider"
) -> DataFrame:
    """The gate per group, with thresholds by ``on`` given as ``0.1``, ``10`` or ``10%`` text.

    The thresholds are a settings table of one row per provider; the groups are counted before the join.
    """
    counted = summarize(annotated, by)
    if thresholds is None:
        limited = counted.withColumn("threshold", F.lit(DEFAULT_THRESHOLD))
    else:
        limits = thresholds.select(on, threshold_column(F.col("threshold")).alias("threshold"))
        limited = counted.join(limits, on, "left").fillna({"threshold": DEFAULT_THRESHOLD})
    return limited.withColumn("passed", F.col("invalid_share") < F.col("threshold"))


def validation_events(
    annotated: DataFrame,
    by: tuple[str, ...],
    id_columns: tuple[str, ...],
    details_per_event: int = 1000,
) -> DataFrame:
    """Audit events of the invalid rows per group, with their details.

    A group with many invalid rows becomes several events (``part`` of ``parts``) of about
    ``details_per_event`` rows each, so no event grows with the data and no detail is left out.
    """
    spark, folder = annotated.sparkSession, f"{scratch_dir(annotated.sparkSession, 'invalid')}/t"
    bad = invalid_rows(annotated).select(*by, *(c for c in id_columns if c not in by), "errors")
    bad.write.parquet(folder)  # counted and joined: the rules run once, and only what they found is read twice
    bad = spark.read.schema(bad.schema).parquet(folder)
    sizes = bad.groupBy(*by).agg(F.count("*").alias("invalid_count"))
    spread = F.pmod(F.xxhash64(*(F.col(c) for c in id_columns), F.col("errors")), F.col("parts"))
    parts = F.ceil(F.col("invalid_count") / details_per_event).cast("long")
    return (
        bad.join(sizes.withColumn("parts", parts), list(by))
        .withColumn("part", spread)
        .repartition(*by, "part")  # otherwise the join's partitioning would keep a large group in one task
        .groupBy(*by, "invalid_count", "part", "parts")
        .agg(F.sort_array(F.collect_list(F.struct(*id_columns, "errors"))).alias("error_details"))
    )


def reason_code(message: Column, column: Column | None = None) -> Column:
    """The reason code of an error message, for errors that arrive as text."""
    text = F.lower(message)
    name = F.lower(column) if column is not None else F.lit("")

    def says(*words: str) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | text.contains(word)
        return found

    # The words of messages that decide the code, in this order.
    rules = (
        (MISSING_COL, says("column") & says("not in", "missing")),
        (BAD_DATE, name.contains("date") & says("type", "datetime")),
        (NON_NUMERIC_PRICE, name.isin(*OHLC) & says("float", "numeric")),
        (NEGATIVE_VOLUME, (name == "volume") & says("negative", "< 0")),
        (NON_NUMERIC_VOLUME, (name == "volume") & says("int", "numeric")),
        (TYPE_ERROR, says("float", "int", "coerce")),
        (CONSTRAINT_VIOLATION, says("check", "constraint")),
    )
    return F.coalesce(*(F.when(broken, code) for code, broken in rules), F.lit(VALIDATION_ERROR))


def feed_problems(df: DataFrame) -> list[str]:
    """What makes a feed unusable as a whole: no rows, missing columns, or a date that is no date."""
    problems = [f"missing column {c}" for c in missing_feed_columns(df)]
    dates = [f for f in df.schema.fields if f.name.lower() == "date"]
    if not dates:
        problems.append("no date column")
    elif not isinstance(dates[0].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)):
        problems.append(f"date has type {dates[0].dataType.simpleString()}")
    if df.isEmpty():
        problems.append("no rows")
    return problems


def require_feed(df: DataFrame) -> None:
    if problems := feed_problems(df):
        raise MappingError("; ".join(problems))


def handle(
    spark: SparkSession,
    df: DataFrame,
    folder: str,
    by: tuple[str, ...] = ("provider", "ticker"),
    id_columns: tuple[str, ...] = ("ticker", "date"),
    threshold: float = DEFAULT_THRESHOLD,
    abort: bool = True,
    buckets: int = QUARANTINE_BUCKETS,
) -> tuple[DataFrame, bool]:
    """Check a feed, keep the invalid rows and their audit events below ``folder``, then apply the gate.

    Invalid rows lie in ``buckets`` folders by hash of their group, sorted by it, with all columns (:func:`quarantined_rows`): the
    number of folders does not grow with the groups.

    The checked frame is written once, split by validity, so the source is read once and the valid rows are
    read back by partition pruning. The folder must be new: a run never overwrites an earlier one.
    """
    checked = f"{folder}/checked"
    annotated = annotate(df).withColumn("is_valid", F.size("errors") == 0)
    annotated.write.mode("errorifexists").partitionBy("is_valid").parquet(checked)
    schema = T.StructType([*annotated.schema.fields])
    stored = spark.read.schema(schema).parquet(checked)
    bad = stored.filter(~F.col("is_valid")).drop("is_valid")
    bucket = F.pmod(F.xxhash64(*(F.col(c) for c in by)), F.lit(buckets))
    spread = bad.drop("errors").withColumn("_bucket", bucket).hint("rebalance", F.col("_bucket"))
    spread.sortWithinPartitions("_bucket", *by).write.partitionBy("_bucket").csv(f"{folder}/invalid", header=True)
    validation_events(bad, by, id_columns).write.mode("append").json(f"{folder}/events")
    passed = check_threshold(summarize(stored), threshold, abort)
    return stored.filter("is_valid").drop("is_valid", "errors"), passed


def quarantined_rows(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """The invalid rows that :func:`handle` kept below ``folder``, as text; ``columns`` are those of the checked feed."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").csv(f"{folder}/invalid", header=True)


def check_metadata(documents: DataFrame, column: str) -> DataFrame:
    """Check snapshot-metadata documents (JSON text) against the metadata contract; adds ``problems``."""
    # The contract's keys, types and patterns.
    patterns = {
        "snapshot_date": r"^\d{4}-\d{2}-\d{2}$",
        "checksum": "^[a-fA-F0-9]{64}$",
        "schema_version": r"^\d+\.\d+\.\d+$",
    }
    needed = ("ticker", "snapshot_date", "rows", "checksum", "schema_version", "source")
    allowed = (*needed, "snapshot_version", "notes", "generated_by", "rows_summary")
    texts = ("ticker", "snapshot_date", "checksum", "schema_version", "source", "notes", "generated_by")
    whole = ("rows", "snapshot_version")

    doc = F.try_parse_json(F.col(column))
    keys = F.map_keys(F.from_json(F.col(column), "map<string,string>"))
    value = {k: F.get_json_object(F.col(column), f"$.{k}") for k in allowed}

    def kind(key: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(doc, f"$.{key}", "variant"))

    def problem(when: Column, text: str) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.lit(text))

    def present(key: str) -> Column:
        return F.array_contains(keys, key)

    checks = [
        *(problem(~present(k), f"{k} is missing") for k in needed),
        problem(F.size(F.array_except(keys, F.array(*(F.lit(k) for k in allowed)))) > 0, "unknown keys"),
        *(problem(present(k) & (kind(k) != "STRING"), f"{k} is not text") for k in texts),
        *(problem(present(k) & (kind(k) != "BIGINT"), f"{k} is not a whole number") for k in whole),
        *(problem(present(k) & ~value[k].rlike(p), f"{k} has the wrong form") for k, p in patterns.items()),
        problem(value["rows"].try_cast("bigint") < 0, "rows is negative"),
        problem(
            value["snapshot_date"].rlike(patterns["snapshot_date"])
            & F.try_to_date(value["snapshot_date"], "yyyy-MM-dd").isNull(),
            "snapshot_date is no calendar date",
        ),
    ]
    readable = F.array_compact(F.array(*checks))
    return documents.withColumn(
        "problems", F.when(doc.isNull() | keys.isNull(), F.array(F.lit("not a JSON object"))).otherwise(readable)
    )
