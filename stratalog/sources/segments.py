"""A multi-version table kept as immutable Parquet segments and numbered manifests.

A write adds a segment and then a manifest that lists it; the manifest's rename is the commit, and
fails if another writer has committed the same number.  A reader takes the segments of the newest
manifest once, and keeps seeing exactly these: segments are never changed, and only ``vacuum``
deletes files.  Segments are partitioned by shard and sorted by key within files, so a keyed read
prunes to one shard's files and skips row groups by their key statistics.

All file access goes through Hadoop's file system, so a table may lie in any store that Spark
reads.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import shard_of
from ..operators import compaction, versions
from ..operators.compaction import Segment
from ..plans.access import keyed
from ..schema import SHARDS

SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("shard", T.IntegerType())])


class Conflict(Exception):
    """Another writer has committed this manifest number."""


@dataclass
class Manifest:
    number: int = 0
    next_segment: int = 1
    max_seq: int = 0
    segments: list[Segment] = field(default_factory=list)  # newest first


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    # -- files -----------------------------------------------------------------------------

    def _p(self, name: str):
        return self._jpath(f"{self.path}/{name}")

    def _names(self) -> list[str]:
        root = self._jpath(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []

    def manifest(self) -> Manifest:
        """The newest commit."""
        numbers = [int(n[9:]) for n in self._names() if n.startswith("manifest-") and n[9:].isdigit()]
        if not numbers:
            return Manifest()
        stream = self._fs.open(self._p(f"manifest-{max(numbers)}"))
        try:
            text = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        raw = json.loads(text)
        return Manifest(raw["number"], raw["next_segment"], raw["max_seq"], [Segment(**s) for s in raw["segments"]])

    def _commit(self, m: Manifest) -> Manifest:
        """Write to a name of its own, then rename: the one that comes second fails."""
        temp = self._p(f".manifest-{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        final = self._p(f"manifest-{m.number}")
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise Conflict(m.number)
        return m

    def _segment(self, num: int, rows: DataFrame, checked: bool = False) -> tuple[Segment, int]:
        """The segment written from the rows, and their highest sequence number.  The rows are computed
        once: facts, ranges and files come from a persisted copy.  With ``checked`` an empty key is an
        error, before anything is written."""
        name = f"{self.path}/segment-{num:06d}"
        rows = rows.select("key", F.col("seq").cast("long").alias("seq"), F.col("kind").cast("int").alias("kind"), "value").withColumn("shard", shard_of(F.col("key"))).persist()
        try:
            bad = F.coalesce(F.max(F.col("key").isNull() | (F.length("key") == 0)), F.lit(False))
            n, smallest, largest, top, empty = rows.agg(F.count("*"), F.min("key"), F.max("key"), F.coalesce(F.max("seq"), F.lit(0)), bad).collect()[0]
            if checked and empty:
                raise ValueError("empty key")
            # Ranges of shard and key, so a hot shard is many files; a keyed read skips row groups by their
            # key statistics and bloom filters.
            ordered = rows.repartitionByRange("shard", "key").sortWithinPartitions("shard", "key", F.desc("seq"))
            keys = n // SHARDS + 16  # of a file, about
            ordered.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(keys)).partitionBy("shard").parquet(name)
        finally:
            rows.unpersist()
        size = self._fs.getContentSummary(self._jpath(name)).getLength()
        return Segment(num, size, n, smallest, largest), top

    # -- reads -----------------------------------------------------------------------------

    def versions(self, m: Manifest | None = None) -> DataFrame:
        """All versions of a snapshot: a union of its segments' files in one scan."""
        m = m or self.manifest()
        paths = [f"{self.path}/segment-{s.num:06d}" for s in m.segments]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        out = None
        for p in paths:
            one = self.spark.read.schema(SCHEMA).parquet(p)
            out = one if out is None else out.unionByName(one)
        return out

    def get(self, key: str, as_of: int | None = None) -> DataFrame:
        return versions.newest(keyed(self.versions(), key), as_of)

    def scan(self, start: str | None = None, end: str | None = None, as_of: int | None = None) -> DataFrame:
        """Segments whose key range does not meet the scan's are not read."""
        m = self.manifest()
        kept = [s for s in m.segments if s.entries and not (end is not None and s.smallest >= end) and not (start is not None and s.largest < start)]
        return versions.scan(self.versions(Manifest(m.number, m.next_segment, m.max_seq, kept)), start, end, as_of)

    # -- writes ----------------------------------------------------------------------------

    def write(self, batch: DataFrame, base: Manifest | None = None) -> Manifest:
        """Commit a batch ``pos, key, value`` (null value deletes) at once; its i-th row in the
        order of ``pos`` gets the i-th next sequence number.  An empty batch commits nothing, an
        empty key fails the batch.  With ``base``, only directly behind that commit."""
        m = base or self.manifest()
        empty = self.spark.createDataFrame([], SCHEMA).drop("shard")
        s, _ = self._segment(m.next_segment, versions.put(empty, batch, m.max_seq, checked=False), checked=True)
        if not s.entries:
            return m
        return self._commit(Manifest(m.number + 1, m.next_segment + 1, m.max_seq + s.entries, [s, *m.segments]))

    def put(self, key: str, value: str) -> Manifest:
        return self.write(self.spark.createDataFrame([(0, key, value)], "pos long, key string, value string"))

    def delete(self, key: str) -> Manifest:
        """Succeeds for a key that is not there."""
        return self.write(self.spark.createDataFrame([(0, key, None)], "pos long, key string, value string"))

    def cas(self, key: str, value: str, expected: str | None = None) -> tuple[bool, str | None]:
        """Put if the key's value is ``expected`` (None: if it is absent); whether it was, and the
        value found.  A commit between the read and the write is a ``Conflict``."""
        m = self.manifest()
        got = versions.newest(keyed(self.versions(m), key)).collect()
        found = got[0].value if got else None
        if found == expected:
            self.write(self.spark.createDataFrame([(0, key, value)], "pos long, key string, value string"), m)
        return found == expected, found

    def append(self, rows: DataFrame) -> Manifest:
        """Commit versions ``key, seq, kind, value`` that have their sequence numbers already, as a
        log's replay gives them."""
        m = self.manifest()
        s, top = self._segment(m.next_segment, rows)
        return self._commit(Manifest(m.number + 1, m.next_segment + 1, max(m.max_seq, top), [s, *m.segments]))

    # -- maintenance -----------------------------------------------------------------------

    def compact(self, keep_from: int | None = None) -> Manifest:
        """Merge one run of neighbours, if the policy picks one."""
        m = self.manifest()
        run = compaction.pick(m.segments)
        if not run:
            return m
        at = m.segments.index(run[0])
        bottom = at + len(run) == len(m.segments)
        merged = compaction.compact(self.versions(Manifest(segments=run)), bottom, keep_from)
        s, _ = self._segment(m.next_segment, merged)
        kept = [*m.segments[:at], *([s] if s.entries else []), *m.segments[at + len(run) :]]
        return self._commit(Manifest(m.number + 1, m.next_segment + 1, m.max_seq, kept))

    def export(self, path: str, as_of: int | None = None) -> None:
        """Live contents at one sequence number, sorted by key over the files in order."""
        live = versions.newest(self.versions(), as_of).withColumn("kind", F.lit(1))
        live.select("key", "seq", "kind", "value").repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)

    def restore(self, path: str) -> Manifest:
        """Replace all contents by an exported table; numbering goes on behind its highest."""
        m = self.manifest()
        rows = self.spark.read.schema(T.StructType(SCHEMA.fields[:4])).parquet(path)
        s, top = self._segment(m.next_segment, rows)
        return self._commit(Manifest(m.number + 1, m.next_segment + 1, top, [s] if s.entries else []))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete what the newest ``keep`` manifests don't list; returns the deleted names."""
        names = self._names()
        numbers = sorted((int(n[9:]) for n in names if n.startswith("manifest-")), reverse=True)
        live = set()
        for n in numbers[:keep]:
            stream = self._fs.open(self._p(f"manifest-{n}"))
            raw = json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
            stream.close()
            live |= {f"segment-{s['num']:06d}" for s in raw["segments"]} | {f"manifest-{n}"}
        gone = [n for n in names if n not in live and (n.startswith(("segment-", "manifest-", ".manifest-")))]
        for n in gone:
            self._fs.delete(self._p(n), True)
        return sorted(gone)

    def stats(self) -> dict[str, int]:
        m = self.manifest()
        return {"commits": m.number, "segments": len(m.segments), "entries": sum(s.entries for s in m.segments), "bytes": sum(s.bytes for s in m.segments), "max_seq": m.max_seq}


def sized(rows: DataFrame) -> DataFrame:
    """``pos, bytes`` of a run of segments made from versions by blocks of sequence numbers; for
    queries about picking."""
    return rows.groupBy("pos").agg(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 9).alias("bytes"))


__all__ = ["Conflict", "Manifest", "Segment", "Store", "sized"]
