"""Run queries in Spark and their SQL twins in DuckDB, and compare the rows.

``python tests/compare.py SF_DIR [NAME ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    """A value in a form that compares equal across engines."""
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def counted(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir: str, name: str, queries: dict, oracles: dict) -> tuple[bool, str]:
    started = time.time()
    df = queries[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if name not in oracles:
        return True, f"{len(rows)} rows, no SQL ({seconds:.1f}s)"
    relation = connection.execute(oracles[name])
    columns = [d[0] for d in relation.description]
    expected = relation.fetchall()
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    ours, theirs = counted(df.columns, rows), counted(columns, expected)
    if ours == theirs:
        return True, f"{len(rows)} rows equal ({seconds:.1f}s)"
    extra, missing = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return False, f"{len(rows)} vs {len(expected)} rows {sorted(columns)}\n    spark {extra}\n    sql   {missing}"


def main() -> None:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    from barwright.session import build_session

    sf_dir, *chosen = sys.argv[1:]
    spark = build_session("compare", "local[8]", 8, **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, queries, oracles = connect(sf_dir), entry.queries(), entry.oracle_sql()
    failed = 0
    for name in chosen or queries:
        try:
            ok, message = compare(spark, connection, sf_dir, name, queries, oracles)
        except Exception as error:  # report and go on with the next query
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {message}", flush=True)
    print(f"{failed} failed")
    spark.stop()


if __name__ == "__main__":
    main()
