"""Fingerprints of a stored table, kept up to date with its versions.

A ticker's fingerprint is a hash of sums over its row digests, and sums can be added up. The sums are kept per unit of the table
(calendar year and bucket) in a log beside it, one run a data folder. Units are never changed once they are written: an upsert
writes new ones for what it touches, so only their rows are hashed, and the sums of all other units are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions.fingerprints import WORDS, fingerprint_of, row_checksum, word_sums
from barwright.functions.paths import decoded_path
from barwright.sources.log import RunLog
from barwright.sources.table import YearTable

PRINTS = "unit string, ticker string, rows long, " + ", ".join(f"w{i} decimal(38,0)" for i in range(WORDS))


class TablePrints:
    """The word sums of a table's units."""

    def __init__(self, spark: SparkSession, table: YearTable, root: str | None = None) -> None:
        self.table = table
        self.log = RunLog(spark, root or f"{table.root}/prints", PRINTS)

    def _units(self, version: int | None = None) -> list[str]:
        return self.table.unit_paths(version)

    def missing(self, version: int | None = None) -> list[str]:
        """The units whose rows have not been hashed."""
        known = {r["run"] for r in self.log.read().select("run").distinct().collect()}  # one a data folder
        return [unit for unit in self._units(version) if _folder(unit) not in known]

    def _rows(self, units: list[str]) -> DataFrame:
        rows = self.table.load(units)
        if not units:
            return rows.withColumn("unit", F.lit(None).cast("string"))
        return rows.withColumn("unit", _unit_of("_metadata.file_path"))

    def new_rows(self, version: int | None = None) -> DataFrame:
        """The rows that have to be hashed, with the unit that holds them."""
        return self._rows(self.missing(version))

    def update(self, version: int | None = None) -> None:
        """Hash the rows of units that are new since the last update; repeated, it does nothing."""
        by_folder: dict[str, list[str]] = {}
        for unit in self.missing(version):
            by_folder.setdefault(_folder(unit), []).append(unit)
        for folder, units in by_folder.items():  # one or few a run: an upsert writes one data folder
            rows = self.table.load(units).select(F.col("_metadata.file_path").alias("_file"), "ticker", row_checksum().alias("_digest"))
            files = rows.groupBy("_file", "ticker").agg(F.count("*").alias("rows"), *word_sums(F.col("_digest")))  # paths are decoded once a file and ticker
            sums = files.withColumn("unit", _unit_of("_file")).groupBy("unit", "ticker")
            self.log.record(folder, sums.agg(F.sum("rows").alias("rows"), *(F.sum(f"w{i}").alias(f"w{i}") for i in range(WORDS))))

    def fingerprints(self, version: int | None = None) -> DataFrame:
        """``ticker, checksum, rows`` of a version, the newest by default: as :func:`ticker_fingerprints` of its rows."""
        self.update(version)
        units = self.log.spark.createDataFrame([(u,) for u in self._units(version)], "unit string")
        kept = self.log.read().join(units, "unit", "left_semi")
        words = [F.sum(f"w{i}") for i in range(WORDS)]
        return kept.groupBy("ticker").agg(fingerprint_of(F.sum("rows"), words).alias("checksum"), F.sum("rows").alias("rows"))


def _unit_of(file: str) -> Column:
    """The folder that a file lies in."""
    return F.regexp_replace(decoded_path(F.col(file)), "/[^/]+$", "")


def _folder(unit: str) -> str:
    """The name of the data folder that a unit lies in, which its upsert has written."""
    return unit.split("/_year=", 1)[0].rsplit("/", 1)[1]
