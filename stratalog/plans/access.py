"""Plan shapes that Catalyst cannot find itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import shard_number
from ..operators import fold, versions


def keyed(table: DataFrame, key: str) -> DataFrame:
    """Rows of one key.  Where the table is partitioned by shard, the key's shard is added as a
    condition, as no optimizer derives it from the key; files of other shards are not listed."""
    out = table.where(F.col("key") == F.lit(key))
    return out.where(F.col("shard") == shard_number(key)) if "shard" in table.columns else out


def state(log: DataFrame, ordered: bool | None = None) -> DataFrame:
    """``key, value`` after a log: newest version by key if it only puts and deletes, an ordered
    fold if it compares and swaps.  ``ordered`` tells, where the caller knows."""
    if ordered is None:
        ordered = not log.where(F.col("op").isin("cas", "purge")).isEmpty()
    if ordered:
        return fold.state(log)
    put = F.col("op") == "put"
    v = log.where(F.col("op").isin("put", "delete")).select("key", F.col("idx").alias("seq"), put.cast("int").alias("kind"), F.when(put, F.col("value")).alias("value"))
    return versions.newest(v).select("key", "value")


def read(log: DataFrame, key: str, mode: str, at: int) -> DataFrame:
    """``key, value`` at an index of the log, of at most one row.  Mode ``log`` orders the read among the
    commands and folds them up to there; ``index`` reads a state that has applied at least that much,
    here by versions.  Both give the same, as long as the log has no compare-and-swap."""
    own = log.where((F.col("key") == F.lit(key)) & (F.col("idx") <= at))
    if mode == "log":
        return fold.state(own).select("key", "value")
    if mode == "index":
        return state(own, ordered=False)
    raise ValueError(f"no read mode {mode}")
