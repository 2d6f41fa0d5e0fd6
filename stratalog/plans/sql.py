"""SQL over the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register(spark: SparkSession, **tables: DataFrame) -> None:
    """Temporary views by name, for example ``register(spark, state=..., versions=...)``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
