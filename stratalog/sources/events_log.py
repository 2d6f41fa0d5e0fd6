"""A canonical command log over the ``events`` table.

Purchases and signups put, errors delete, clicks compare and swap, views get.  Some clients send
the same or an earlier sequence number again, so sessions have duplicates to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``idx, client_id, req_seq, op, key, value, expected`` of every event, keys as strings."""
    e = F.col("event_id")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        (e + 1).alias("idx"),
        (F.col("user_id") % 8).alias("client_id"),
        (F.floor(e / 8) - e % 5 + 5).cast("long").alias("req_seq"),
        F.when(kind.isin("purchase", "signup"), "put").when(kind == "error", "delete").when(kind == "click", "cas").otherwise("get").alias("op"),
        F.concat(F.lit("user"), F.col("user_id")).alias("key"),
        e.cast("string").alias("value"),
        F.when(e % 3 != 0, (e - 1).cast("string")).alias("expected"),
    )


def versions(log: DataFrame) -> DataFrame:
    """``key, seq, kind, value`` of the log's puts and deletes."""
    writes = log.where(F.col("op").isin("put", "delete"))
    put = F.col("op") == "put"
    return writes.select("key", F.col("idx").alias("seq"), put.cast("int").alias("kind"), F.when(put, F.col("value")).alias("value"))
