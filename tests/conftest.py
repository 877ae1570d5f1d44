from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from barwright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests", "local[4]", 4, **{"spark.checkpoint.dir": str(shared), "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def bars(spark):
    """Build canonical rows from short tuples ``(ticker, day, close)`` or full ones."""

    def make(rows, source="desk"):
        full = []
        for ticker, day, *rest in rows:
            close = rest[0]
            low, high = (rest[1], rest[2]) if len(rest) > 2 else (close, close)
            full.append((ticker, day, close, high, low, close, 100, source, "2024-01-31 00:00:00", "x"))
        text = "ticker string, date string, open double, high double, low double, close double, volume long, source string, fetched_at string, raw_checksum string"
        df = spark.createDataFrame(full, text)
        return df.selectExpr(
            "ticker", "cast(date as date) date", "open", "high", "low", "close", "volume", "source",
            "cast(fetched_at as timestamp) fetched_at", "raw_checksum",
        )

    return make


def rows(df, *order):
    """Rows as plain tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple(str(x) for x in t))
