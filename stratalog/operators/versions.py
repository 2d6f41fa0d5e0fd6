"""Reads of a multi-version map: newest visible version of a key, as of a sequence number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PUT


def newest(versions: DataFrame, as_of: int | None = None, tombstones: bool = False) -> DataFrame:
    """``key, value, seq`` (and ``kind``) of every key's newest version at ``as_of``.

    Tombstones are dropped after the newest is chosen, never before.  One partial and one final
    hash aggregate; a key with a third of all versions costs one row a task.
    """
    v = versions if as_of is None else versions.where(F.col("seq") <= as_of)
    best = v.groupBy("key").agg(F.max_by(F.struct("kind", "value", "seq"), "seq").alias("v")).select("key", "v.value", "v.seq", "v.kind")
    return best if tombstones else best.where(F.col("kind") == PUT).drop("kind")


def state(versions: DataFrame, as_of: int | None = None) -> DataFrame:
    return newest(versions, as_of)


def get(versions: DataFrame, key, as_of: int | None = None) -> DataFrame:
    """At most one row; a deleted or unknown key gives none.  The key reaches the scan."""
    return newest(versions.where(F.col("key") == F.lit(key)), as_of)


def get_many(versions: DataFrame, keys: DataFrame, as_of: int | None = None) -> DataFrame:
    """Newest rows of the keys of another table; only their versions are aggregated."""
    return newest(versions.join(keys.select("key").distinct(), "key", "left_semi"), as_of)


def in_range(start=None, end=None, column: str = "key") -> Column:
    """``start <= key < end`` in byte order; a null bound is none."""
    out = F.lit(True)
    if start is not None:
        out &= F.col(column) >= F.lit(start)
    if end is not None:
        out &= F.col(column) < F.lit(end)
    return out


def scan(versions: DataFrame, start=None, end=None, as_of: int | None = None) -> DataFrame:
    """Pairs of a key range in key order, from one snapshot.  The range reaches the scan, below
    the aggregate, as it only concerns the key."""
    return newest(versions.where(in_range(start, end)), as_of).orderBy("key")


def table_statistics(versions: DataFrame) -> DataFrame:
    """Entries, smallest and largest key, and highest sequence number."""
    return versions.agg(F.count("*").alias("entries"), F.min("key").alias("smallest"), F.max("key").alias("largest"), F.max("seq").alias("max_seq"))


NUMBERED = 100_000  # rows that one task numbers, about


def put(versions: DataFrame, rows: DataFrame, seq: int, checked: bool = True) -> DataFrame:
    """Versions with a batch of ``key, value`` (null value deletes) added behind ``seq``, numbered
    in the order of ``pos``.  An empty key is an error, unless the caller looks for it (``checked``)."""
    from .ordered import running_sum

    bad = F.col("key").isNull() | (F.length("key") == 0)
    key = F.when(bad, F.raise_error(F.lit("empty key")).cast(dict(rows.dtypes)["key"])).otherwise(F.col("key")) if checked else F.col("key")
    rows = running_sum(rows.select("pos", "key", "value"), [], "pos", F.lit(1), "_n", NUMBERED)
    numbered = rows.select(key.alias("key"), (F.col("_n") + seq).cast("long").alias("seq"), F.col("value").isNotNull().cast("int").alias("kind"), "value")
    return versions.unionByName(numbered)


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that differ between two tables, with the side that has them; empty if they agree."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
