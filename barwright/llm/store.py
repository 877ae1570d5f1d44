"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barwright.session import scratch_dir


def stored(spark: SparkSession, purpose: str, df: DataFrame, **options: str) -> DataFrame:
    """Write a table once and read it back: what several steps use is computed once and survives lost executors."""
    folder = f"{scratch_dir(spark, purpose)}/t"
    df.write.options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
