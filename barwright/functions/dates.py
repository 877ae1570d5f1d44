"""Dates, stamps and date ranges held in text."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of stamps and of dates in paths.
STAMP_FORMAT = "yyyyMMdd'T'HHmmss'Z'"
STAMP_PATTERN = r"^\d{8}T\d{6}Z$"
ZONE_PATTERN = r"(Z|[+-]\d{2}:?\d{2})$"
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
COMPACT_PATTERN = r"^\d{8}$"
PATH_DATE_PATTERN = r"(\d{4}-\d{2}-\d{2}|\d{8})"


def strict_iso_date(text: Column) -> Column:
    """``YYYY-MM-DD`` only; anything else is null."""
    return F.when(text.rlike(ISO_PATTERN), F.try_to_date(text, "yyyy-MM-dd"))


def _is_iso(text: Column) -> Column:
    """Whether a text is a plain ``YYYY-MM-DD``, for which a cast does what the slower parsers do."""
    return (F.octet_length(text) == 10) & text.rlike(ISO_PATTERN)


def feed_date(text: Column) -> Column:
    """``YYYY-MM-DD`` or ``MM-DD-YYYY``, blanks around it allowed; anything else is null."""
    trimmed = F.trim(text)
    return F.when(_is_iso(trimmed), trimmed.try_cast("date")).otherwise(F.coalesce(
        F.when(trimmed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(trimmed, "yyyy-M-d")),
        F.when(trimmed.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(trimmed, "M-d-yyyy")),
    ))


def lenient_date(value: Column) -> Column:
    """A date out of text that may carry a time and a zone; the calendar day is the one in UTC."""
    stamped = F.when(value.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), value.try_cast("timestamp"))
    return F.when(_is_iso(value), value.try_cast("date")).otherwise(F.to_date(stamped))


def utc_date(value: Column, zone: str | None = None) -> Column:
    """The UTC calendar day of a wall-clock stamp in ``zone``; without a zone the stamp is UTC already."""
    return F.to_date(F.to_utc_timestamp(value, zone) if zone else value)


def dashed_date(text: Column) -> Column:
    """``YYYYMMDD`` becomes ``YYYY-MM-DD``; other text passes through, trimmed."""
    trimmed = F.trim(text)
    dashed = F.concat_ws("-", trimmed.substr(1, 4), trimmed.substr(5, 2), trimmed.substr(7, 2))
    return F.when(trimmed.rlike(COMPACT_PATTERN), dashed).otherwise(trimmed)


def compact_stamp(at: Column) -> Column:
    """``YYYYMMDDTHHMMSSZ`` of an instant."""
    return F.date_format(at, STAMP_FORMAT)


def stamp_of(at: datetime | str) -> str:
    """The compact stamp of an instant, or a text that is one; a time without a zone is refused.

    >>> stamp_of(datetime(2024, 1, 31, 12, tzinfo=timezone.utc))
    '20240131T120000Z'
    """
    if isinstance(at, str):
        if not re.fullmatch(STAMP_PATTERN, at):
            raise ValueError(f"{at!r} is no stamp YYYYMMDDTHHMMSSZ")
        return at
    if at.utcoffset() is None:
        raise ValueError(f"{at} has no time zone")
    return at.astimezone(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def zoned_stamp(text: Column) -> Column:
    """The compact stamp of an ISO time in text; null for one without a zone, or that is no time."""
    return F.when(text.rlike(ZONE_PATTERN), compact_stamp(F.try_to_timestamp(text)))


def is_compact_stamp(text: Column) -> Column:
    return F.coalesce(text.rlike(STAMP_PATTERN), F.lit(False))


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def snapshot_range(
    payload: Column, path: Column, start: Column | None = None, end: Column | None = None
) -> tuple[Column, Column]:
    """``(start, end)`` of a snapshot as text, empty when unknown.

    Explicit values win, then the keys of the JSON payload, then the first two dates in the path.
    A bad payload counts as having no keys.
    """
    keys = F.from_json(
        payload, "start string, start_date string, end string, end_date string", {"mode": "PERMISSIVE"}
    )
    found = F.regexp_extract_all(F.coalesce(path, F.lit("")), F.lit(PATH_DATE_PATTERN), F.lit(1))
    none = F.lit(None).cast("string")

    def pick(given: Column | None, key: str, position: int) -> Column:
        value = F.coalesce(
            _filled(given if given is not None else none),
            _filled(keys[key]),
            _filled(keys[f"{key}_date"]),
            F.try_element_at(found, F.lit(position)),
            F.lit(""),
        )
        return dashed_date(value)

    return pick(start, "start", 1), pick(end, "end", 2)
