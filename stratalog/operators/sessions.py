"""Exactly-once client sessions over a command log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _client() -> Column:
    """Commands of one session.  A register command at index i opens the session of client i with
    sequence 0; client 0 and null have no session, and their commands stand alone by their index."""
    no_session = F.coalesce("client_id", F.lit(0)) == 0
    return F.when(F.col("op") == "register", F.col("idx")).when(no_session, -F.col("idx")).otherwise(F.col("client_id"))


def _groups(log: DataFrame) -> list[str]:
    """Sessions belong to a group's log, where there are several."""
    return ["grp"] if "grp" in log.columns else []


def _with_session(log: DataFrame) -> DataFrame:
    """``log`` with ``_client`` and ``_epoch``: registering an id that is in use starts its session
    anew."""
    own = log.withColumn("_client", _client())
    order = Window.partitionBy(*_groups(log), "_client").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("_epoch", F.sum((F.col("op") == "register").cast("int")).over(order))


def mark_duplicates(log: DataFrame) -> DataFrame:
    """``log`` with ``dup``: the client has a session whose last sequence number is not below
    this one.

    A command is a duplicate exactly if an earlier one of its client, duplicate or not, has a
    sequence number as high, because those that were skipped were lower still.  So no state is
    carried but a running maximum.
    """
    seq = F.when(F.col("op") == "register", F.lit(0)).otherwise(F.col("req_seq"))
    before = Window.partitionBy(*_groups(log), "_client", "_epoch").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    own = _with_session(log).withColumn("_seq", seq)
    dup = F.coalesce(F.col("_seq") <= F.max("_seq").over(before), F.lit(False)) & (F.col("op") != "register")
    return own.withColumn("dup", dup).drop("_client", "_epoch", "_seq")


def number_requests(requests: DataFrame) -> DataFrame:
    """Requests ``client_id, idx`` with ``req_seq``: 1, 2, ... of each client, reads too."""
    order = Window.partitionBy("client_id").orderBy("idx")
    return requests.withColumn("req_seq", F.row_number().over(order).cast("long"))


def sessions(log: DataFrame) -> DataFrame:
    """``client_id, seq`` of every session after the log."""
    seq = F.when(F.col("op") == "register", F.lit(0)).otherwise(F.col("req_seq"))
    own = _with_session(log).select(*_groups(log), F.col("_client").alias("client_id"), "_epoch", seq.alias("seq")).where("client_id > 0")
    return own.groupBy(*_groups(log), "client_id").agg(F.max_by("seq", F.struct("_epoch", "seq")).alias("seq"))


def replies(log: DataFrame, results: DataFrame, columns: tuple[str, ...] = ("found", "value", "success")) -> DataFrame:
    """``idx, dup`` and the reply of every command: its own result, or for a duplicate the latest
    result that its session holds.

    ``log`` is marked (``mark_duplicates``); ``results`` has the results of the commands that ran.
    """
    order = Window.partitionBy(*_groups(log), "_client", "_epoch").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    own = _with_session(log).select(*_groups(log), "idx", "dup", "_client", "_epoch")
    own = own.join(results.select(*_groups(log), "idx", F.struct(*columns).alias("_r")), [*_groups(log), "idx"], "left")
    latest = F.last(F.when(~F.col("dup"), F.col("_r")), ignorenulls=True).over(order)
    at = [*_groups(log), "idx", "dup"]
    return own.select(*at, latest.alias("_r")).select(*at, *(F.col(f"_r.{c}").alias(c) for c in columns))
