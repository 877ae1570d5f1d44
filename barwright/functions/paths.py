"""File paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_path(path: Column) -> Column:
    """A path without the ``file:`` scheme that file listings add."""
    return F.regexp_replace(path, "^file:/+", "/")


def decoded_path(path: Column) -> Column:
    """The plain form of a path that Spark gives URL-encoded, as ``_metadata.file_path`` is; a ``+`` is a plus."""
    return plain_path(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))
