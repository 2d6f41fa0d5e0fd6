"""Tumbling counts as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """``start, n`` of tumbling windows; rows later than ``late`` behind the newest are dropped."""
    own = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return own.select(F.col("w.start").alias("start"), "n")


def contiguous_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks ``transfer, offset, size`` of a batch that join up from offset 0, each once: what
    out-of-order and repeated deliveries leave."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("transfer").orderBy("offset")
    own = chunks.dropDuplicates(["transfer", "offset"])
    own = own.withColumn("_end", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("_gap", F.max((F.col("_end") != F.col("offset")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return own.where(F.col("_gap") == 0).drop("_end", "_gap")
