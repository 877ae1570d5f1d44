"""Provider feeds to canonical price rows.

Column lookup happens on the driver from ``df.columns`` alone; the data passes through one ``select``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.functions.dates import feed_date, lenient_date
from barwright.schema import FEED_COLUMNS, PRICES, Field, no_nan


class MappingError(ValueError):
    """The feed cannot be mapped: a required column is missing or a label is ambiguous."""


@dataclass(frozen=True)
class ProviderMapping:
    """Which feed labels may hold each canonical column; the first that exists is taken."""

    name: str
    columns: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def candidates(self, column: str) -> tuple[str, ...]:
        return self.columns.get(column, (column,))


# The labels that known feeds use.
TITLE_CASE_FEED = ProviderMapping(
    "title_case",
    {
        "open": ("Open", "open"),
        "high": ("High", "high"),
        "low": ("Low", "low"),
        "close": ("Close", "close"),
        "volume": ("Volume", "volume"),
        "adj_close": ("Adj Close", "adj_close"),
    },
)
NUMBERED_FEED = ProviderMapping(
    "numbered",
    {
        "open": ("1. open",),
        "high": ("2. high",),
        "low": ("3. low",),
        "close": ("4. close",),
        "adj_close": ("5. adjusted close",),
        "volume": ("6. volume", "5. volume"),
    },
)
_PROVIDERS: dict[str, ProviderMapping] = {p.name: p for p in (TITLE_CASE_FEED, NUMBERED_FEED)}


def register_provider(mapping: ProviderMapping) -> None:
    _PROVIDERS[mapping.name] = mapping


def provider(name: str) -> ProviderMapping:
    """The mapping of a named provider; an unknown one uses the common labels."""
    return _PROVIDERS.get(name, TITLE_CASE_FEED)


def find_column(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    """The first candidate that exists, whatever its case and with blanks or underscores."""
    by_label = {c.lower(): c for c in columns}
    for candidate in candidates:
        label = candidate.lower()
        for form in (label, label.replace(" ", "_")):
            if form in by_label:
                return by_label[form]
    return None


def quoted(name: str) -> Column:
    """A column by its exact label, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing_feed_columns(df: DataFrame, mapping: ProviderMapping = TITLE_CASE_FEED) -> list[str]:
    return [c for c in FEED_COLUMNS if find_column(df.columns, mapping.candidates(c)) is None]


def require_feed_columns(df: DataFrame, mapping: ProviderMapping = TITLE_CASE_FEED) -> None:
    if missing := missing_feed_columns(df, mapping):
        raise MappingError(f"missing required columns {missing}; available {df.columns}")


def flatten_labels(df: DataFrame) -> DataFrame:
    """Two-level labels, read as structs, reduced to the first level."""
    selected = []
    for f in df.schema.fields:
        if not isinstance(f.dataType, T.StructType):
            selected.append(quoted(f.name))
            continue
        inner = f.dataType.names
        if len(inner) != 1:
            raise MappingError(f"label {f.name!r} holds several series {inner}")
        selected.append(quoted(f.name)[inner[0]].alias(f.name))
    return df.select(*selected)


def explode_series(df: DataFrame, document: str, series_key: str, ticker_path: str) -> DataFrame:
    """Rows of a JSON document ``{..., series_key: {date: {label: value}}}``, one per date.

    The labels of the inner maps must be mapped with a :class:`ProviderMapping` afterwards.
    """
    labels = {c for options in NUMBERED_FEED.columns.values() for c in options}
    series = F.from_json(
        F.get_json_object(F.col(document), f"$['{series_key}']"), "map<string,map<string,string>>"
    )
    ticker = F.get_json_object(F.col(document), ticker_path)
    # read once a document, by a generator of one row: beside the second generator it would be read anew for every date
    read = df.select(F.explode(F.array(F.struct(ticker.alias("ticker"), F.map_entries(series).alias("entries")))).alias("_read"))
    entry = F.col("_entry")
    return read.select("_read.ticker", "_read.entries").select("ticker", F.explode("entries").alias("_entry")).select(
        "ticker",
        entry["key"].alias("date"),
        *(entry["value"].getItem(label).alias(label) for label in sorted(labels)),
    )


def to_number(value: Column) -> Column:
    """A double out of text; text that is no number, and NaN, become null.

    Type suffixes (``1d``) and hexadecimal text are refused, although a plain cast takes them.
    """
    text = value.cast("string")
    usual = ~text.rlike("[xXdDfF]")  # spares most text the slower pattern, which begins anew at every place
    number = F.when(usual | ~text.rlike(r"[xX]|[0-9.][dDfF]\s*$"), text).try_cast("double")
    return F.nanvl(number, F.lit(None).cast("double"))


def to_count(value: Column) -> Column:
    """A whole number out of text such as ``100`` or ``100.0``; a fractional value becomes null."""
    text = value.cast("string")
    whole = F.when(text.contains("."), F.regexp_replace(text, r"\.0*\s*$", "")).otherwise(text).try_cast("bigint")
    number = to_number(value)  # only text such as 1e3 gets here
    return F.coalesce(whole, F.when(number == F.floor(number), number.try_cast("bigint")))


def to_canonical(
    df: DataFrame,
    source: str | Column,
    ticker: str | Column | None = None,
    fetched_at: datetime | Column | None = None,
    raw_checksum: Column | None = None,
    mapping: ProviderMapping | None = None,
    fields: tuple[Field, ...] = PRICES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Map a provider feed, holding any number of tickers, to the canonical columns and their order.

    ``ticker`` and ``source`` may be a literal or a column. Values that do not parse become null: run the
    quality rules on the feed itself when their loss must be reported. Without ``raw_checksum`` each row gets
    the SHA-256 of its own raw values, which needs no shuffle. ``keep`` names feed columns to carry along.
    """
    mapping = mapping or (provider(source) if isinstance(source, str) else TITLE_CASE_FEED)
    require_feed_columns(df, mapping)
    source_column = F.lit(source) if isinstance(source, str) else source
    if ticker is None:
        label = find_column(df.columns, ("ticker", "symbol"))
        if label is None:
            raise MappingError("no ticker column; pass ticker=")
        ticker_column = quoted(label)
    else:
        ticker_column = F.lit(ticker) if isinstance(ticker, str) else ticker
    date_label = find_column(df.columns, ("date",))
    if date_label is None:
        raise MappingError("no date column")
    if fetched_at is None:
        fetched_at = F.current_timestamp()
    raw_values = [F.coalesce(quoted(c).cast("string"), F.lit("")) for c in df.columns]
    special = {
        "ticker": ticker_column,
        "date": F.coalesce(
            feed_date(quoted(date_label).cast("string")), lenient_date(quoted(date_label).cast("string"))
        ),
        "source": source_column,
        "fetched_at": F.lit(fetched_at) if isinstance(fetched_at, datetime) else fetched_at,
        "raw_checksum": raw_checksum if raw_checksum is not None else F.sha2(F.concat_ws("\x1f", *raw_values), 256),
    }

    def value(f: Field) -> Column:
        if f.name in special:
            return special[f.name]
        label = find_column(df.columns, mapping.candidates(f.name))
        if label is None:
            return F.lit(None)
        if f.kind == "float":
            return to_number(quoted(label))
        return to_count(quoted(label)) if f.kind == "int" else quoted(label)

    return df.select(
        *(value(f).cast(f.spark_type).alias(f.name) for f in fields), *(quoted(c) for c in keep)
    )


def price_column(df: DataFrame) -> str:
    """The price to use for returns: the adjusted close when there is one, else the close."""
    for name in ("adj_close", "Adj Close", "close", "Close"):
        if name in df.columns:
            return name
    raise MappingError(f"no price column in {df.columns}")


def with_adjusted_close(df: DataFrame) -> DataFrame:
    """Add ``adj_close`` from ``close`` where the feed has none."""
    if "adj_close" in df.columns or "close" not in df.columns:
        return df
    return df.withColumn("adj_close", F.col("close"))


def strict_high_low(high: Column, low: Column) -> Column:
    """The mapping rule: a missing side, ``high > low``, or both zero."""
    return high.isNull() | low.isNull() | (high > low) | ((high == 0) & (low == 0))


def mapping_verdicts(canonical: DataFrame) -> DataFrame:
    """Per feed and ticker: how many rows break the mapping rules. A feed with any such row is refused."""
    broken = ~strict_high_low(F.col("high"), F.col("low")) | F.col("date").isNull() | F.col("ticker").isNull()
    return (
        canonical.groupBy("source", "ticker")
        .agg(F.count("*").alias("rows"), F.count_if(broken).alias("broken_rows"))
        .withColumn("mapped", F.col("broken_rows") == 0)
    )


def returns_view(returns: DataFrame) -> DataFrame:
    """The view that older readers expect, with the value under the name ``return``."""
    return returns.withColumnRenamed("return_value", "return")


def rename_migration(df: DataFrame, old: str, new: str) -> DataFrame:
    """Copy ``old`` into ``new`` where ``new`` has no value yet, and drop ``old``."""
    if old not in df.columns:
        return df
    merged = F.coalesce(F.col(new), quoted(old)) if new in df.columns else quoted(old)
    return df.withColumn(new, merged).drop(old)

