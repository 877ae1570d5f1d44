"""Queries over the snapshot catalog and over file lists."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.names import basename, is_snapshot_name, named_stamp, named_ticker
from barwright.functions.tickers import SUFFIX, lenient_ticker


def distinct_tickers(prices: DataFrame) -> DataFrame:
    """All tickers, blanks left out. Sort at the sink."""
    return prices.select("ticker").filter("trim(ticker) != ''").distinct()


def latest_per_ticker(catalog: DataFrame) -> DataFrame:
    """The newest catalog row of every ticker, by creation time and then id.

    ``max(struct)`` keeps one candidate per ticker and map task, so a ticker with very many snapshots is no
    heavier than any other.
    """
    rest = [c for c in catalog.columns if c not in ("ticker", "created_at", "id")]
    return (
        catalog.groupBy("ticker")
        .agg(F.max(F.struct("created_at", "id", *rest)).alias("_row"))
        .select(*(F.col(c) if c == "ticker" else F.col(f"_row.{c}") for c in catalog.columns))
    )


def list_snapshots(catalog: DataFrame, ticker: str | None = None, archived: bool = False) -> DataFrame:
    """Catalog rows by archived flag and ticker, newest first."""
    found = catalog.filter(F.coalesce("archived", F.lit(False)) == archived)
    if ticker is not None:
        found = found.filter(F.col("ticker") == ticker)
    return found.orderBy(F.desc("created_at"), F.desc("id"))


def by_ids(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Catalog rows of the given ids."""
    return catalog.join(ids.select("id").distinct(), "id", "left_semi")


def by_paths(paths: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each ``path``, the catalog row it refers to.

    A row may hold the stored form of the path, the full path or the path as given. The forms are tried in that
    order, and among equal ones the newest row is taken.
    """
    # a path below the temporary folder is stored as its file name
    stored = F.when(F.col("path").startswith("/tmp/"), basename(F.col("path"))).otherwise(F.col("path"))
    forms = F.array_distinct(F.array(stored, F.col("path")))
    wanted = paths.select("path", F.posexplode(forms).alias("_rank", "snapshot_path"))
    rest = [c for c in catalog.columns if c != "snapshot_path"]
    order = F.struct((-F.col("_rank")).alias("_rank"), "created_at", "id")
    return (
        wanted.join(catalog.filter("snapshot_path IS NOT NULL"), "snapshot_path")
        .groupBy("path")
        .agg(F.max(F.struct(order.alias("_order"), "snapshot_path", *rest)).alias("_row"))
        .select("path", *(F.col(f"_row.{c}").alias(c) for c in catalog.columns))
    )


def resolve_tickers(requested: DataFrame, prices: DataFrame) -> DataFrame:
    """The stored form of each requested ticker: base preferred over suffixed; null when neither exists."""
    base = lenient_ticker(F.col("requested"))
    forms = F.array(base, F.concat(base, F.lit(SUFFIX)))
    wanted = requested.select("requested").distinct()
    candidates = wanted.select("requested", F.posexplode(forms).alias("_rank", "ticker"))
    found = (
        candidates.join(distinct_tickers(prices), "ticker")
        .groupBy("requested")
        .agg(F.min(F.struct("_rank", "ticker"))["ticker"].alias("ticker"))
    )
    return wanted.join(found, "requested", "left")


def prune_list(files: DataFrame, keep: int = 1, name: str = "name") -> DataFrame:
    """The snapshot files to remove: all but the newest ``keep`` of every ticker, in every ``folder`` if files have one.

    Newest are those with the latest time in their name; a name whose digits are no time comes after them, by the
    file's ``modified`` time if there is one, and then by name. Files whose name does not fit are never removed. The newest ones
    are found with a row-number limit, which Spark applies before the shuffle; the rest of a ticker is then compared with its last
    kept file, so the files of a ticker are never ranked in one place.
    """
    keep = max(1, keep)
    by = ["folder", "ticker"] if "folder" in files.columns else ["ticker"]
    rest = [c for c in files.columns if c not in (name, "folder", "modified")]
    never = F.lit("0001-01-01 00:00:00").cast("timestamp")
    stamp = named_stamp(F.col(name))
    modified = F.col("modified") if "modified" in files.columns else F.lit(None).cast("timestamp")
    ranked = files.filter(is_snapshot_name(F.col(name))).select(
        *by[:-1], name, *rest, named_ticker(F.col(name)).alias("ticker"), stamp.alias("stamp"),
        F.struct(stamp.isNotNull().alias("timed"), F.coalesce(stamp, modified, never).alias("at")).alias("_at"),
    )
    newest_first = Window.partitionBy(*by).orderBy(F.desc("_at"), name)
    last_kept = (
        ranked.select(*by, "_at", name)
        .withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") <= keep)
        .filter(F.col("_rank") == keep)
        .select(*by, F.col("_at").alias("_cut"), F.col(name).alias("_cut_name"))
    )
    older = (F.col("_at") < F.col("_cut")) | ((F.col("_at") == F.col("_cut")) & (F.col(name) > F.col("_cut_name")))
    return ranked.join(last_kept, by).filter(older).select(*by, "stamp", name, *rest)


def purge_candidates(catalog: DataFrame, older_than_days: int, as_of: datetime) -> DataFrame:
    """Live snapshots with a path that are older than the limit. Sort by ``created_at`` at the sink."""
    if older_than_days < 0:
        raise ValueError("older_than_days must not be negative")
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(older_than_days))
    return catalog.filter(
        ~F.coalesce("archived", F.lit(False)) & F.col("snapshot_path").isNotNull() & (F.col("created_at") < cutoff)
    ).select("id", F.col("snapshot_path").alias("path"), "ticker", "created_at", "size_bytes", "checksum")


def last_rows(df: DataFrame, n: int, date: str = "date") -> DataFrame:
    """The ``n`` newest rows, by date and then by all columns."""
    return df.orderBy(F.desc(date), *(c for c in df.columns if c != date)).limit(n)


def head_sample(df: DataFrame, n: int = 5, order: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def basename_collisions(paths: DataFrame, key: Column | None = None) -> DataFrame:
    """``key, path`` of files that would share a name when moved into one folder.

    Colliding names are counted first; only they are joined back, so no list of paths is gathered.
    """
    keyed = paths.select((key if key is not None else basename(F.col("path"))).alias("key"), "path")
    several = keyed.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1")
    return keyed.join(several.select("key"), "key", "left_semi")
