"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trendloom.session import scratch_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh folder below the shared checkpoint folder and read back: cuts lineage and outlives executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
