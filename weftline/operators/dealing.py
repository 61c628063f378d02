"""How rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to several tasks for each core. A table of few bytes is read in few tasks, however much work each of its rows makes."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)
