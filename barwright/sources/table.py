"""Price and return tables on plain Parquet, with upserts.

Parquet folders cannot be merged in place, and overwriting a folder that the same job reads destroys it. A table is
held in units, one per calendar year and hash bucket of the first key. An upsert writes the units it touches to a new
folder, then publishes a small list of which folders hold each unit; the folders of other units are carried over by
reference, and so are those of a unit that only gets rows of new keys: it has up to ``LAYERS`` folders, and no key is in two of them. Readers take the newest complete list, and older lists stay valid for going back. The list also holds the last
batch of every source that feeds the table, so that a batch that is delivered again is known whatever was published since,
and the columns, once a migration has changed them: every version is read by its own. One writer per table: a second one fails on the same version number.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.functions.tickers import lenient_ticker
from barwright.schema import PRICE_KEY, PRICES, Field, fields_from_json, fields_to_json, struct_type
from barwright.sources.files import few_listing_tasks
from barwright.sources.prices import read_prices, stored_form

VERSION_SCHEMA = "version int, year int, bucket int, path string, source string, batch_id long, fields string"
BUCKETS = 16
LAYERS = 8  # folders of a unit, at which an upsert writes it anew


class YearTable:
    """A table keyed by columns that include ``date``. Tickers are stored in their base form."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        fields: tuple[Field, ...] = PRICES,
        keys: tuple[str, ...] = PRICE_KEY,
        buckets: int = BUCKETS,
    ) -> None:
        """``buckets`` is fixed with the first upsert; a table of many terabytes wants thousands."""
        self.buckets = buckets
        self.spark = spark
        self.root = root.rstrip("/")
        self.fields = fields
        self.keys = keys

    def _numbers(self) -> list[int]:
        """Every version number in use, newest first, including one whose writer died before publishing."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.root}/versions")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        taken = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
        return sorted((int(name.removeprefix("v=")) for name in taken if name.startswith("v=")), reverse=True)

    def _published(self, version: int | None = None) -> list:
        """The rows of one published list, one per calendar year the table covers; the newest by default.

        Only that list is read, however many versions there are. A folder without a list is not published.
        """
        for number in self._numbers() if version is None else [version]:
            path = f"{self.root}/versions/v={number}"
            if rows := self.spark.read.schema(VERSION_SCHEMA).json(path).collect():
                return rows
        return []

    def version(self) -> int:
        rows = self._published()
        return rows[0]["version"] if rows else 0

    def last_batch(self, source: str) -> int:
        """The last micro-batch of a source that has been published, -1 before the first."""
        return max((r["batch_id"] for r in self._published() if r["source"] == source), default=-1)

    def _bucket(self) -> Column:
        """The bucket of a row by its first key that is no date."""
        key = next(k for k in self.keys if k != "date")
        return (F.crc32(F.col(key).cast("string").cast("binary")) % self.buckets).cast("int")

    def _declared(self, published: list) -> tuple[Field, ...]:
        """The columns of a published list: those of the last migration before it, or the table's own."""
        text = next((r["fields"] for r in published if r["fields"] is not None), None)
        return self.fields if text is None else fields_from_json(text)

    def columns(self, version: int | None = None) -> tuple[Field, ...]:
        """The columns of a version, the newest by default."""
        return self._declared(self._published(version))

    def load(self, paths: list[str], fields: tuple[Field, ...] | None = None) -> DataFrame:
        """The rows of the named units."""
        schema = struct_type(fields or self.fields)
        with few_listing_tasks(self.spark):
            return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def unit_paths(self, version: int | None = None) -> list[str]:
        """The folders of a version's units, the newest version's by default."""
        return [r["path"] for r in self._published(version) if r["path"] is not None]

    def read(
        self,
        tickers: list[str] | str | None = None,
        start: date | str | None = None,
        end: date | str | None = None,
        version: int | None = None,
    ) -> DataFrame:
        """The rows of a version, the newest by default; units outside the range or of other tickers are not listed at all."""
        low = int(str(start)[:4]) if start is not None else None
        high = int(str(end)[:4]) if end is not None else None
        wanted = None
        if tickers is not None:
            named = [tickers] if isinstance(tickers, str) else tickers
            wanted = {zlib.crc32(stored_form(t).encode()) % self.buckets for t in named}
        published = self._published(version)
        paths = [
            r["path"]
            for r in published
            if r["path"] is not None
            and (low is None or r["year"] >= low)
            and (high is None or r["year"] <= high)
            and (wanted is None or r["bucket"] in wanted)
        ]
        return read_prices(self.load(paths, self._declared(published)), tickers, start, end)

    def upsert(
        self,
        incoming: DataFrame,
        combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
        source: str | None = None,
        batch_id: int = -1,
        prepared: bool = False,
        replacing: DataFrame | None = None,
    ) -> int:
        """Merge rows that are unique by key, and publish the result as the next version.

        ``combine(stored, incoming)`` gives the merged rows; the default replaces rows with equal keys: the incoming rows are
        written as units at once, and the stored rows that stay are added to them. The incoming rows
        are computed once, and their keys are checked before anything is merged: stored rows were checked when they
        came. Only the units that the incoming rows touch are read and written. ``source`` and ``batch_id`` are kept
        with the version, also when a batch has no rows. ``prepared`` rows are taken as they are: written already, with typed
        columns and stored tickers, their keys known to be unique and not null. ``replacing`` are those of them whose keys are stored, where the
        caller knows: a unit that gets none of these keeps its folders and is given one more, up to ``LAYERS``. Returns the published version.
        """
        current = self._published()
        version = current[0]["version"] if current else 0
        fields = self._declared(current)
        number = max(self._numbers(), default=0) + 1
        target = f"{self.root}/data/v={number}-{uuid.uuid4().hex}"
        if combine is None:
            rows = incoming.select(*(f.name for f in fields)) if prepared else self._typed(incoming, fields)
            self._write(rows, target)
            staged = self._written(target, fields)
            if not prepared:
                self._check_keys(staged)
        else:
            staged = self._placed(incoming, fields) if prepared else self._staged(incoming, fields)
        units = sorted(tuple(r) for r in staged.select("_year", "_bucket").distinct().collect())  # years x buckets at most
        if not units and source is None:
            return version
        version = number
        touched = set(units)
        if replacing is not None and combine is None:
            placed = self._placed(replacing, fields).select("_year", "_bucket").distinct()
            folders = Counter((r["year"], r["bucket"]) for r in current if r["path"] is not None)
            touched &= {tuple(r) for r in placed.collect()} | {unit for unit, n in folders.items() if n >= LAYERS}
        kept = [r for r in current if r["path"] is not None and (r["year"], r["bucket"]) not in touched]
        paths = [r["path"] for r in current if (r["year"], r["bucket"]) in touched and r["path"] is not None]
        stored = self.load(paths, fields)
        if combine is not None and units:
            self._write(combine(stored, staged.drop("_year", "_bucket")), target)
        elif paths:
            self._add_kept(stored, staged, target)
        marks = {r["source"]: r["batch_id"] for r in current if r["source"] is not None}
        if source is not None:
            marks[source] = batch_id
        carried = [(r["year"], r["bucket"], r["path"]) for r in kept]
        self._publish(version, carried + _units_of(target, units), marks, current)
        return version

    def migrate(self, fields: tuple[Field, ...], transform: Callable[[DataFrame], DataFrame]) -> int:
        """Publish a version with other columns: ``transform`` of all rows, written unit by unit.

        The rows of every unit are counted before the version becomes visible. Where a count differs from that of the version
        before, nothing is published and the error names the units. Keys must stay as they are; older versions keep their columns.
        """
        current = self._published()
        paths = [r["path"] for r in current if r["path"] is not None]
        if missing := [k for k in self.keys if k not in [f.name for f in fields]]:
            raise ValueError(f"the keys {missing} must stay")
        version = max(self._numbers(), default=0) + 1
        target = f"{self.root}/data/v={version}-{uuid.uuid4().hex}"
        before = self.load(paths, self._declared(current))
        after = transform(before).select(*(F.col(f.name).cast(f.spark_type).alias(f.name) for f in fields))
        self._write(after, target)
        unit = ("_year", "_bucket")
        written = self.spark.read.parquet(target).select(*(F.col(c).cast("int").alias(c) for c in unit)) if paths else None
        units: list[tuple[int, int]] = []
        if written is not None:
            old = before.select(F.year("date").alias("_year"), self._bucket().alias("_bucket")).groupBy(*unit).agg(F.count("*").alias("_old"))
            new = written.groupBy(*unit).agg(F.count("*").alias("_new"))
            counts = old.join(new, list(unit), "full_outer").orderBy(*unit).collect()  # years x buckets at most
            if wrong := [f"{r['_year']}/{r['_bucket']}: {r['_old']} -> {r['_new']}" for r in counts if r["_old"] != r["_new"]]:
                raise ValueError(f"row counts of {self.root} differ; version not published: {', '.join(wrong[:5])}")
            units = [(r["_year"], r["_bucket"]) for r in counts]
        marks = {r["source"]: r["batch_id"] for r in current if r["source"] is not None}
        self._publish(version, _units_of(target, units), marks, current, fields_to_json(fields))
        return version

    def _written(self, target: str, fields: tuple[Field, ...]) -> DataFrame:
        """The rows of the units below a data folder, with their unit."""
        schema = struct_type(fields).add("_year", T.IntegerType()).add("_bucket", T.IntegerType())
        return self.spark.read.schema(schema).parquet(target)

    def _add_kept(self, stored: DataFrame, staged: DataFrame, target: str) -> None:
        """Add the stored rows whose keys do not come again to the units of the incoming rows.

        Which keys stay is found on keys alone; whole rows are moved only for keys that stay.
        """
        staging = f"{self.root}/staging/{uuid.uuid4().hex}"
        keys = list(self.keys)
        stored.select(*keys).join(staged.select(*keys), keys, "left_anti").write.option("compression", "zstd").parquet(staging)
        staying = self.spark.read.schema(stored.select(*keys).schema).parquet(staging)
        if not staying.isEmpty():
            self._write(stored.join(staying, keys, "left_semi"), target, "append")

    def _write(self, rows: DataFrame, target: str, mode: str = "errorifexists") -> None:
        """Rows as unit folders; AQE splits big units and packs small ones, without sampling."""
        texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in self.keys]
        (
            rows.withColumns({"_year": F.year("date"), "_bucket": self._bucket()})
            .withColumns({name: _packed(F.col(name)) for name in texts})
            .hint("rebalance", F.col("_year"), F.col("_bucket"))
            .withColumns({name: _unpacked(F.col(name)) for name in texts})
            .sortWithinPartitions("_year", "_bucket", *self.keys)
            .write.mode(mode)
            .option("compression", "zstd")  # checksums are half of a row, and other codecs leave them as they are
            .partitionBy("_year", "_bucket")
            .parquet(target)
        )

    def _publish(self, version: int, units: list[tuple], marks: dict[str, int], current: list, fields: str | None = None) -> None:
        """Write the list of a version: units ``(year, bucket, path)``, last batches, and the columns if they are not the table's own."""
        fields = fields or next((r["fields"] for r in current if r["fields"] is not None), None)
        entries = [(version, *unit, None, None, fields) for unit in units]
        entries += [(version, None, None, None, name, last, fields) for name, last in marks.items()]
        listed = self.spark.createDataFrame(entries, VERSION_SCHEMA).coalesce(1)
        listed.write.mode("errorifexists").json(f"{self.root}/versions/v={version}")

    def _placed(self, rows: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
        """The table's columns with the unit that each row belongs to."""
        return rows.select(*(f.name for f in fields)).withColumns({"_year": F.year("date"), "_bucket": self._bucket()})

    def _typed(self, incoming: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
        """Incoming rows in stored form."""
        rows = incoming
        if "ticker" in incoming.columns:
            rows = rows.withColumn("ticker", F.nullif(lenient_ticker(F.col("ticker")), F.lit("")))
        return rows.select(*(F.col(f.name).cast(f.spark_type).alias(f.name) for f in fields))

    def _staged(self, incoming: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
        """Incoming rows in stored form, written once, with their keys checked."""
        staging = f"{self.root}/staging/{uuid.uuid4().hex}"
        self._placed(self._typed(incoming, fields), fields).write.option("compression", "zstd").parquet(staging)
        staged = self.spark.read.parquet(staging)
        self._check_keys(staged)
        return staged

    def _check_keys(self, incoming: DataFrame) -> None:
        """No incoming key may be null or appear twice; otherwise nothing is written."""
        empty = F.lit(False)
        for key in self.keys:
            empty = empty | F.col(key).isNull()
        counted = incoming.groupBy(*self.keys).agg(F.count("*").alias("_n"))
        bad = counted.filter((F.col("_n") > 1) | empty).agg(F.count("*")).first()[0]
        if bad:
            raise ValueError(f"{bad} incoming keys of {self.root} are null or not unique; version not published")

    def versions(self) -> DataFrame:
        """Every published list."""
        return self.spark.read.schema(VERSION_SCHEMA).json(f"{self.root}/versions/v=*")


def _packed(text: Column) -> Column:
    """A text as bytes for a shuffle: a checksum, half of a row's bytes there, as the bytes that it spells. Null stays null."""
    spelled = F.unhex(F.when(F.octet_length(text) == 64, text))
    plain = F.concat(F.lit(b"\0"), text.cast("binary"))
    return F.when(F.coalesce(F.lower(F.hex(spelled)) == text, F.lit(False)), F.concat(F.lit(b"\1"), spelled)).otherwise(plain)


def _unpacked(packed: Column) -> Column:
    """The text of :func:`_packed` bytes."""
    held = F.substring(packed, 2, 2**31 - 1)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\1"), F.lower(F.hex(held))).otherwise(held.cast("string"))


def _units_of(target: str, units: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    return [(year, bucket, f"{target}/_year={year}/_bucket={bucket}") for year, bucket in units]
