"""Row differences, merges and cache decisions.

All of them are equi-joins on the row key. The incoming side is first reduced to one row per key on the map
side, so a key that a feed repeats any number of times reaches the join once.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions.fingerprints import group_fingerprint, row_checksum
from barwright.schema import PRICE_KEY, RETURN_KEY, VOLATILE


def last_per_key(df: DataFrame, keys: tuple[str, ...] = PRICE_KEY, sequence: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: the one with the highest ``sequence``; equal ones are decided by their values.

    Written as ``max(struct)``: partial maxima are formed before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in sequence]
    return (
        df.groupBy(*keys)
        .agg(F.max(F.struct(*sequence, *rest)).alias("_row"))
        .select(*(F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns))
    )


def differs(columns: list[str], left: str, right: str) -> Column:
    """Whether any of the columns differs, with null equal to null."""
    comparisons = [~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]
    return reduce(or_, comparisons, F.lit(False))


def classify(
    incoming: DataFrame,
    store: DataFrame,
    keys: tuple[str, ...] = PRICE_KEY,
    ignore: tuple[str, ...] = VOLATILE,
) -> DataFrame:
    """Every incoming row with ``change_type`` new, changed or unchanged, from one left join."""
    compared = [c for c in incoming.columns if c in store.columns and c not in keys and c not in ignore]
    known = store.select(*keys, *compared, F.lit(True).alias("_known")).alias("s")
    matched = incoming.alias("i").join(known, [F.col(f"i.{k}") == F.col(f"s.{k}") for k in keys], "left")
    change = (
        F.when(F.col("s._known").isNull(), "new")
        .when(differs(compared, "i", "s"), "changed")
        .otherwise("unchanged")
    )
    return matched.select(*(F.col(f"i.{c}") for c in incoming.columns), change.alias("change_type"))


def diff(
    incoming: DataFrame,
    store: DataFrame,
    keys: tuple[str, ...] = PRICE_KEY,
    ignore: tuple[str, ...] = VOLATILE,
) -> DataFrame:
    """The incoming rows that a store must take: new and changed ones."""
    return classify(incoming, store, keys, ignore).filter("change_type != 'unchanged'")


def new_rows(incoming: DataFrame, store: DataFrame, keys: tuple[str, ...] = PRICE_KEY) -> DataFrame:
    return incoming.join(store.select(*keys), list(keys), "left_anti")


def changed_rows(
    incoming: DataFrame,
    store: DataFrame,
    keys: tuple[str, ...] = PRICE_KEY,
    ignore: tuple[str, ...] = VOLATILE,
) -> DataFrame:
    return classify(incoming, store, keys, ignore).filter("change_type = 'changed'").drop("change_type")


def key_difference(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = PRICE_KEY) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` does not have."""
    return left.select(*keys).subtract(right.select(*keys))


def key_intersection(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = PRICE_KEY) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


def concat(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def date_bounds(df: DataFrame, date: str = "date") -> tuple:
    """The first and last date: two values, aggregated before they reach the driver."""
    row = df.agg(F.min(date).alias("low"), F.max(date).alias("high")).first()
    return row["low"], row["high"]


def classify_in_range(incoming: DataFrame, store: DataFrame, **options) -> DataFrame:
    """:func:`classify` with the store pruned to the incoming date range before the join."""
    low, high = date_bounds(incoming)
    if low is None:
        return classify(incoming, store.limit(0), **options)
    return classify(incoming, store.filter(F.col("date").between(low, high)), **options)


def change_counts(classified: DataFrame, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Rows processed and skipped per group."""
    taken = F.col("change_type") != "unchanged"
    return classified.groupBy(*by).agg(
        F.count_if(taken).alias("processed_rows"), F.count_if(~taken).alias("skipped_rows")
    )


def merge(store: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = PRICE_KEY) -> DataFrame:
    """Upsert: incoming rows replace stored rows with the same key. Both sides must be unique by key."""
    kept = store.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.select(*store.columns).unionByName(incoming.select(*store.columns))


def merge_insert_only(store: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = PRICE_KEY) -> DataFrame:
    """Insert rows with unknown keys and leave stored rows as they are."""
    return store.unionByName(new_rows(incoming, store, keys).select(*store.columns))


def merge_returns(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert of returns: the value is replaced, the first ``created_at`` is kept."""
    keys = list(RETURN_KEY)
    s = store.select(*keys, F.col("return_value").alias("_old"), F.col("created_at").alias("_created"))
    return incoming.join(s, keys, "full_outer").select(
        "ticker",
        "date",
        F.coalesce("return_value", "_old").alias("return_value"),
        "return_type",
        F.coalesce("_created", "created_at").alias("created_at"),
    )


def ticker_fingerprints(df: DataFrame, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """One fingerprint per ticker over the stable columns, whatever the order or partitioning of the rows."""
    return df.groupBy(*by).agg(group_fingerprint(row_checksum()).alias("checksum"), F.count("*").alias("rows"))


def cache_decisions(
    fingerprints: DataFrame,
    last_snapshots: DataFrame,
    as_of: datetime | Column,
    ttl_seconds: float = 0,
    force: bool = False,
) -> DataFrame:
    """Per ticker: ``miss``, ``checksum_match`` (no expiry) or ``within_ttl``.

    ``last_snapshots`` has one row per ticker: ``ticker, last_checksum, generated_at``.
    """
    same = F.coalesce(F.col("checksum") == F.col("last_checksum"), F.lit(False))
    instant = F.lit(as_of) if isinstance(as_of, datetime) else as_of
    age = F.unix_timestamp(instant.cast("timestamp")) - F.unix_timestamp(F.col("generated_at").cast("timestamp"))
    if force:
        decision = F.lit("miss")
    elif ttl_seconds <= 0:
        decision = F.when(same, "checksum_match").otherwise("miss")
    else:
        fresh = F.coalesce(age < ttl_seconds, F.lit(False))
        decision = F.when(same & fresh, "within_ttl").otherwise("miss")
    return fingerprints.join(last_snapshots, "ticker", "left").select(
        "ticker", "checksum", "rows", decision.alias("decision")
    )


def rows_to_refresh(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of the tickers that the cache does not cover."""
    return df.join(decisions.filter("decision = 'miss'").select("ticker"), "ticker", "left_semi")


def file_cache_decisions(
    files: DataFrame, processed: DataFrame, as_of: datetime | Column, ttl_seconds: float | None = None
) -> DataFrame:
    """Per file ``(path, sha256)``: whether an equal, fresh entry ``(path, sha256, processed_at text)`` exists.

    Without a TTL an entry is always fresh; with one, an entry whose time does not parse is stale.
    """
    entry = processed.select("path", F.col("sha256").alias("_sha"), "processed_at")
    cached = F.coalesce(F.col("sha256") == F.col("_sha"), F.lit(False)) & _fresh(as_of, ttl_seconds)
    return files.join(entry, "path", "left").select("path", "sha256", cached.alias("cached"))


def _fresh(as_of: datetime | Column, ttl_seconds: float | None) -> Column:
    if ttl_seconds is None:
        return F.lit(True)
    instant = F.lit(as_of) if isinstance(as_of, datetime) else as_of
    age = F.unix_timestamp(instant.cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp("processed_at"))
    return F.coalesce(age < ttl_seconds, F.lit(False))


def listing_decisions(
    listing: DataFrame, processed: DataFrame, as_of: datetime | Column, ttl_seconds: float | None = None
) -> DataFrame:
    """Per listed file ``(path, size_bytes, modified)``: whether a fresh entry of the same size and time exists, and its hash.

    What this decides needs no look into the file; :func:`file_cache_decisions` decides the others by their hash.
    """
    entry = processed.select("path", F.col("size_bytes").alias("_size"), F.col("modified").alias("_modified"), "sha256", "processed_at")
    same = (F.col("size_bytes") == F.col("_size")) & (F.col("modified") == F.col("_modified"))
    cached = F.coalesce(same, F.lit(False)) & _fresh(as_of, ttl_seconds)
    return listing.join(entry, "path", "left").select(
        "path", "size_bytes", "modified", F.when(cached, F.col("sha256")).alias("sha256"), cached.alias("cached")
    )


def file_tickers(df: DataFrame, file: str = "file") -> DataFrame:
    """The single ticker of every file; ``ticker`` is null and ``ambiguous`` true where a file holds several.

    Two extremes are enough to tell, so no list of tickers is gathered.
    """
    extremes = df.groupBy(file).agg(F.min("ticker").alias("_low"), F.max("ticker").alias("_high"))
    several = F.coalesce(F.col("_low") != F.col("_high"), F.lit(False))
    return extremes.select(file, F.when(~several, F.col("_low")).alias("ticker"), several.alias("ambiguous"))
