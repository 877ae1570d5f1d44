"""Ticker symbols as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The exchange suffix and the shape of a valid base symbol.
SUFFIX = ".SA"
BASE_PATTERN = "^[A-Z0-9]{4,8}$"


def _trimmed_upper(ticker: Column) -> Column:
    return F.upper(F.regexp_replace(ticker, r"^\s+|\s+$", ""))


def lenient_ticker(ticker: Column) -> Column:
    """Trim, upper-case and drop one exchange suffix, without a validity test."""
    lenient = F.regexp_replace(_trimmed_upper(ticker), r"\.SA$", "")
    return F.when(ticker.rlike("^[A-Z0-9]+$") & ~ticker.endswith("\n"), ticker).otherwise(lenient)  # most are in that form already


def normalize_ticker(ticker: Column) -> Column:
    """The base symbol, or null when the input is not a valid symbol."""
    base = lenient_ticker(ticker)
    return F.when(base.rlike(BASE_PATTERN) & base.rlike("[0-9]"), base)


def ticker_error(ticker: Column) -> Column:
    """Why a symbol was refused; null when it is valid."""
    base = lenient_ticker(ticker)
    return (
        F.when(ticker.isNull(), "ticker must be a string")
        .when(_trimmed_upper(ticker) == "", "ticker cannot be empty")
        .when(~base.rlike(BASE_PATTERN), "ticker has the wrong shape")
        .when(~base.rlike("[0-9]"), "ticker must contain a digit")
    )


def provider_ticker(ticker: Column) -> Column:
    """The base symbol with the exchange suffix; null when the input is invalid."""
    return F.concat(normalize_ticker(ticker), F.lit(SUFFIX))


def ticker_variants(ticker: Column) -> Column:
    """``[base, base + suffix]``; null when the input is invalid."""
    base = normalize_ticker(ticker)
    return F.when(base.isNotNull(), F.array(base, F.concat(base, F.lit(SUFFIX))))


def returns_ticker(ticker: Column) -> Column:
    """The form stored with returns: every suffix text is removed first, then the lenient rule applies."""
    return lenient_ticker(F.replace(ticker, F.lit(SUFFIX), F.lit("")))


def feed_ticker(ticker: Column) -> Column:
    """The form a price feed expects: an alphanumeric symbol that ends in a digit gets the suffix."""
    symbol = _trimmed_upper(ticker)
    return F.when(symbol.rlike("^[A-Z0-9]*[0-9]$"), F.concat(symbol, F.lit(SUFFIX))).otherwise(symbol)


def split_ticker_list(df: DataFrame, column: str, default: tuple[str, ...] = ()) -> DataFrame:
    """One row per valid symbol of a comma-separated list; rows without any get the default list."""
    valid = F.filter(
        F.transform(F.split(F.col(column), ","), normalize_ticker), lambda symbol: symbol.isNotNull()
    )
    fallback = F.array(*(F.lit(t) for t in default)).cast("array<string>")
    chosen = F.when(F.size(valid) > 0, valid).otherwise(fallback)
    return df.withColumn("ticker", F.explode(chosen))
