"""Compaction of version segments: what is kept, and which segments are merged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import PUT
from .versions import newest

MIN_RUN, MAX_SEGMENTS = 4, 10


@dataclass(frozen=True)
class Segment:
    """Facts of a segment; a list of them goes from the newest to the oldest."""

    num: int
    bytes: int
    entries: int = 0
    smallest: str | None = None
    largest: str | None = None


def compact(versions: DataFrame, bottom: bool, keep_from: int | None = None) -> DataFrame:
    """Newest version of every key; tombstones go only if no older segment lies below
    (``bottom``).  With ``keep_from``, what snapshots from that sequence number on need stays:
    versions above it, and the newest at or below it."""
    columns = ["key", "seq", "kind", "value"]
    if keep_from is None:
        out = newest(versions, tombstones=True).select(*columns)
        return out.where(F.col("kind") == PUT) if bottom else out
    old = newest(versions, keep_from, tombstones=True).select(*columns)
    old = old.where(F.col("kind") == PUT) if bottom else old
    return versions.where(F.col("seq") > keep_from).select(*columns).unionByName(old)


def pick(segments: list[Segment]) -> list[Segment]:
    """Neighbours in age to merge: the longest run of at least ``MIN_RUN`` similar in size to its
    first (of equally long ones the last); else, with more than ``MAX_SEGMENTS``, the smallest
    ``MIN_RUN`` in a row; else none."""
    best: list[Segment] = []
    at = 0
    while at < len(segments):
        head = segments[at].bytes
        run = [segments[at]]
        for s in segments[at + 1 :]:
            if not (s.bytes <= 2 * head and head <= 2 * s.bytes):
                break
            run.append(s)
        if len(run) >= max(MIN_RUN, len(best)):
            best = run
        at += len(run)
    if best or len(segments) <= MAX_SEGMENTS:
        return best
    windows = [segments[i : i + MIN_RUN] for i in range(len(segments) - MIN_RUN + 1)]
    return min(windows, key=lambda w: sum(s.bytes for s in w))


def pick_window(segments: DataFrame, length: int = MIN_RUN) -> DataFrame:
    """``pos, bytes`` of the cheapest window of segments ``pos, bytes``; of equal ones the first.
    A manifest has few rows."""
    order = Window.orderBy("pos")
    own = segments.withColumn("bytes", F.sum("bytes").over(order.rowsBetween(0, length - 1))).withColumn("_n", F.count("*").over(order.rowsBetween(0, length - 1)))
    return own.where(F.col("_n") == length).select("pos", "bytes").orderBy("bytes", "pos").limit(1)


def replaced(manifest: DataFrame, inputs: DataFrame, output: DataFrame) -> DataFrame:
    """A manifest ``pos, num, bytes`` with a run of segments replaced by its merged output, which
    takes the place of the newest input."""
    at = inputs.agg(F.min("pos").alias("pos"))
    kept = manifest.join(F.broadcast(inputs.select("num")), "num", "left_anti").select("pos", "num", "bytes")
    return kept.unionByName(output.crossJoin(F.broadcast(at)).select("pos", "num", "bytes"))
