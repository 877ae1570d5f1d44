"""Checksums of rows and of groups of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 8  # a SHA-256 digest is eight words of 32 bits


def number_text(value: Column) -> Column:
    """Text of a number that every engine writes the same way: ten decimals. NaN has none.

    Numbers of 10^28 and more have their engine's own exact text.
    """
    return F.coalesce(value.try_cast("decimal(38,10)").cast("string"), F.when(~F.isnan(value), value.cast("string")))


def row_checksum(
    ticker: str = "ticker", date: str = "date", volume: str = "volume", source: str = "source"
) -> Column:
    """SHA-256 of ``ticker|date|open|high|low|close|volume|source``, with ``None`` for no value."""
    parts = [
        F.col(ticker),
        F.date_format(F.col(date), "yyyy-MM-dd"),
        *(number_text(F.col(c)) for c in ("open", "high", "low", "close")),
        F.col(volume).cast("string"),
        F.col(source),
    ]
    return F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("None")) for p in parts)), 256)


def word_sums(digest: Column) -> list[Column]:
    """Aggregates ``w0`` to ``w7``: each 32-bit word of the digests, summed over the group.

    The upper and lower halves of a word are summed as plain longs, which is many times faster than a sum of decimals and holds
    2^47 rows; only the sums of a group become decimals.
    """
    sums = []
    for i in range(WORDS):
        word = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        high, low = (F.sum(half).cast("decimal(20,0)") for half in (F.shiftright(word, 16), word.bitwiseAND(F.lit(0xFFFF))))
        sums.append((high * F.lit(1 << 16).cast("decimal(6,0)") + low).cast("decimal(38,0)").alias(f"w{i}"))
    return sums


def fingerprint_of(count: Column, sums: list[Column]) -> Column:
    """The fingerprint of a group from the number of its digests and their word sums."""
    return F.sha2(F.concat_ws(",", count.cast("string"), *(w.cast("string") for w in sums)), 256)


def group_fingerprint(digest: Column) -> Column:
    """An aggregate that fingerprints the digests of a group, whatever their order.

    Each 32-bit word of the digests is summed over the group, and the sums are hashed with the count. Sums
    combine on the map side, so a group of any size needs no sort and never meets in one task as a list; and they can be
    kept and added up.
    """
    return fingerprint_of(F.count(digest), word_sums(digest))
