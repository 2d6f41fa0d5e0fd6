"""Running values over few, large groups.

A window over a group is one task.  Here a group's rows are cut into chunks by ranges of a numeric
order column; windows run within chunks, and what lies before a chunk (or behind it) comes from one
row a chunk.  So a group with a third of all rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 1_000_000  # rows of a chunk, about


def chunked(rows: DataFrame, order: str, size: int = CHUNK) -> DataFrame:
    """``rows`` with ``_chunk``, a number that grows with the order column."""
    n, lo, hi = rows.agg(F.count("*"), F.min(order), F.max(order)).collect()[0]
    chunks = -(-n // size)
    if chunks <= 1 or hi == lo:
        return rows.withColumn("_chunk", F.lit(0).cast("long"))
    width = max(1, -(-(int(hi) - int(lo) + 1) // chunks))
    return rows.withColumn("_chunk", F.floor((F.col(order) - F.lit(int(lo))) / F.lit(width)).cast("long"))


def _beside(rows: DataFrame, by: list[str], value: Column, over: Column) -> DataFrame:
    """The rows with ``_beside``: a value of each chunk, combined over the chunks before it."""
    per = rows.groupBy(*by, "_chunk").agg(value.alias("_value"))
    per = per.withColumn("_beside", over).drop("_value")
    keys = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by] + [F.col("_chunk") == F.col("_k_chunk")]
    renamed = per.select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col("_chunk").alias("_k_chunk"), "_beside")
    renamed = renamed if by else F.broadcast(renamed)  # one row a chunk
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    return rows.join(renamed, on, "left").drop(*(f"_k_{c}" for c in by), "_k_chunk")


def running_sum(rows: DataFrame, by: list[str], order: str, value: Column, name: str, size: int = CHUNK, then: tuple = ()) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and including each row, in the order of ``order`` (and
    ``then``, among rows of equal order)."""
    own = chunked(rows.withColumn("__v", value), order, size)
    before = F.sum("_value").over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    own = _beside(own, by, F.sum("__v"), before)
    within = F.sum("__v").over(Window.partitionBy(*by, "_chunk").orderBy(order, *then).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn(name, F.coalesce("_beside", F.lit(0)) + within).drop("__v", "_chunk", "_beside")


def previous(rows: DataFrame, by: list[str], order: str, values: dict[str, str], size: int = CHUNK) -> DataFrame:
    """``rows`` with values of the row before, under new names (``values``: name -> column)."""
    s = F.struct(*(F.col(c).alias(n) for n, c in values.items()))
    own = chunked(rows.withColumn("__v", s), order, size)
    before = F.last("_value", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    own = _beside(own, by, F.max_by("__v", F.col(order)), before)
    near = F.lag("__v").over(Window.partitionBy(*by, "_chunk").orderBy(order))
    own = own.withColumn("__v", F.coalesce(near, F.col("_beside")))
    return own.withColumns({n: F.col(f"__v.{n}") for n in values}).drop("__v", "_chunk", "_beside")


def least_behind(rows: DataFrame, by: list[str], order: str, value: str, name: str, size: int = CHUNK) -> DataFrame:
    """``rows`` with the smallest ``value`` of the rows behind each one."""
    own = chunked(rows, order, size)
    behind = F.min("_value").over(Window.partitionBy(*by).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1))
    own = _beside(own, by, F.min(value), behind)
    within = F.min(value).over(Window.partitionBy(*by, "_chunk").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1))
    return own.withColumn(name, F.least("_beside", within)).drop("_chunk", "_beside")
