"""Intermediate tables in the shared checkpoint folder: later steps read files, not a lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from palinode.session import scratch_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the folder of spark.checkpoint.dir and read it again."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
