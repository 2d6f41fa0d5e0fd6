"""Shard moves that can be interrupted after any step and run again.

The groups' logs are one table of commands, and the shard map is one value of a ``Store``, so every
change of the map is a compare-and-swap.  A move marks the shard in the map, freezes it in its group,
imports its pairs in pages into the new group, purges it in the old one, and flips the map.  What is
done already is read from the logs and the map, so a second run goes on where the first one ended,
and steps that ran twice change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import shard_of
from ..schema import FROZEN, GONE, OPEN
from ..sources.segments import Store
from . import shards

LOG = (
    "grp long, idx long, client_id long, req_seq long, op string, key string, value string, expected string, shard int,"
    " kvs array<struct<key:string,value:string>>, last boolean"
)
MAP = "shard-map"


class StaleMap(Exception):
    """Another writer has changed the shard map."""


class Groups:
    """The logs of some groups, and the map of their shards."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, f"{self.path}/map")

    # -- the map: {shard: (group, group that it is moving to, or 0)}

    def map(self) -> dict[int, tuple[int, int]]:
        got = self.store.get(MAP).collect()
        return self._parsed(got[0].value) if got else {}

    @staticmethod
    def _parsed(text: str) -> dict[int, tuple[int, int]]:
        return {int(s): (int(g), int(m)) for s, g, m in (x.split(":") for x in text.split())}

    @staticmethod
    def _text(m: dict[int, tuple[int, int]]) -> str:
        return " ".join(f"{s}:{g}:{to}" for s, (g, to) in sorted(m.items()))

    def create_map(self, groups: list[int]) -> dict[int, tuple[int, int]]:
        """The default map, unless there is one already."""
        rows = shards.default_map(self.spark, groups).collect()
        done, found = self.store.cas(MAP, self._text({r.shard: (r.grp, r.moving) for r in rows}))
        return self.map() if done else self._parsed(found)

    def swap(self, old: dict[int, tuple[int, int]], new: dict[int, tuple[int, int]]) -> None:
        if not self.store.cas(MAP, self._text(new), self._text(old))[0]:
            raise StaleMap

    def map_rows(self) -> DataFrame:
        return self.spark.createDataFrame([(s, g, to) for s, (g, to) in self.map().items()], "shard int, grp long, moving long")

    # -- the logs

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def append(self, commands: DataFrame) -> None:
        """Commands of ``LOG`` with indexes of their own."""
        commands.select(*(x.split()[0] for x in LOG.split(", "))).write.mode("append").parquet(f"{self.path}/log")

    def _admin(self, grp: int, op: str, shard: int, pages: DataFrame | None = None) -> None:
        top = self.log().where(F.col("grp") == grp).agg(F.coalesce(F.max("idx"), F.lit(0))).collect()[0][0]
        if pages is None:
            pages = self.spark.range(1).select(F.lit(0).alias("page"), F.array().cast("array<struct<key:string,value:string>>").alias("kvs"), F.lit(True).alias("last"))
        none = F.lit(None).cast("string")
        self.append(
            pages.select(
                F.lit(grp).cast("long").alias("grp"), (F.col("page") + top + 1).cast("long").alias("idx"), F.lit(0).cast("long").alias("client_id"), F.lit(0).cast("long").alias("req_seq"), F.lit(op).alias("op"),
                none.alias("key"), none.alias("value"), none.alias("expected"), F.lit(shard).alias("shard"), "kvs", "last",
            )
        )

    def pairs(self) -> DataFrame:
        """``grp, key, value`` that the groups hold."""
        return shards.replay(self.log())[0]

    def state_of(self, grp: int, shard: int) -> int | None:
        admin = self.log().where((F.col("grp") == grp) & (F.col("shard") == shard) & F.col("op").isin(*shards.ADMIN))
        got = shards.timeline(admin.select("grp", "shard", "idx", "op", "last")).agg(F.max_by("state", "idx").alias("s")).collect()
        return got[0].s

    # -- the move

    def move(self, shard: int, to: int, max_rows: int = 1000, max_bytes: int = 1 << 20, stop_before: str | None = None) -> list[str]:
        """The steps that were taken; ``stop_before`` ends the run early, as a lost driver would."""
        m = self.map()
        if shard not in m:
            raise ValueError(f"no shard {shard}")
        source, moving = m[shard]
        if source == to and not moving:
            return []
        if moving not in (0, to):
            raise ValueError(f"shard {shard} is moving to group {moving}")
        steps = []
        if not moving:
            self.swap(m, m | {shard: (source, to)})
            m = m | {shard: (source, to)}
            steps.append("mark")
        if stop_before == "freeze":
            return steps
        if self.state_of(source, shard) not in (FROZEN, GONE):
            self._admin(source, "freeze", shard)
            steps.append(f"freeze@{source}")
        if stop_before == "import":
            return steps
        if self.state_of(to, shard) != OPEN:
            self._admin(to, "import", shard, self._pages(source, shard, max_rows, max_bytes))
            steps.append(f"import@{to}")
        if stop_before == "purge":
            return steps
        if self.state_of(source, shard) != GONE:
            self._admin(source, "purge", shard)
            steps.append(f"purge@{source}")
        if stop_before == "flip":
            return steps
        self.swap(m, m | {shard: (to, 0)})
        return [*steps, "flip"]

    def _pages(self, source: int, shard: int, max_rows: int, max_bytes: int) -> DataFrame:
        """``page, kvs, last`` of the shard's pairs in its group; one empty page if it has none."""
        own = self.pairs().where((F.col("grp") == source) & (shard_of(F.col("key")) == shard)).select(F.col("grp").alias("part"), "key", "value")
        chunks = shards.import_chunks(own, max_rows, max_bytes).groupBy(F.col("chunk").alias("page")).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("kvs"))
        top = chunks.agg(F.max("page")).collect()[0][0]
        if top is None:
            return self.spark.range(1).select(F.lit(0).alias("page"), F.array().cast("array<struct<key:string,value:string>>").alias("kvs"), F.lit(True).alias("last"))
        return chunks.withColumn("last", F.col("page") == top)
