"""Benchmark result files: one JSON object a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BENCH


def read(spark: SparkSession, path: str) -> DataFrame:
    """Results by name; files of another kind (no throughput) are left out."""
    return spark.read.schema(BENCH).option("multiLine", True).json(path).where(F.col("throughput").isNotNull()).orderBy("name")
