"""Shards: routing, the admin commands' timeline, purges, moves and whole-log replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import default_group, shard_of
from ..schema import FROZEN, GONE, OPEN, SHARDS
from . import fold, sessions

ADMIN = ("freeze", "import", "purge")
SMALL = 64  # marks that are not cut by ranges of indexes in an as-of join
RANGES = 4096  # of indexes, at most


def default_map(spark: SparkSession, groups: list[int]) -> DataFrame:
    """The shard map before any move."""
    return spark.range(SHARDS).select(F.col("id").cast("int").alias("shard"), default_group(F.col("id"), groups).alias("grp"), F.lit(0).cast("long").alias("moving"))


def route(rows: DataFrame, shard_map: DataFrame) -> DataFrame:
    """Rows with the shard and the owning group of their key; the map has 16 rows."""
    return rows.withColumn("shard", shard_of(F.col("key"))).join(F.broadcast(shard_map.select("shard", "grp")), "shard")


def owned(pairs: DataFrame, shard_map: DataFrame) -> DataFrame:
    """Of pairs ``grp, key, value``, those that the owning group holds: during a move a key is
    then seen once."""
    own = pairs.withColumn("shard", shard_of(F.col("key")))
    return own.join(F.broadcast(shard_map.select("shard", "grp")), ["shard", "grp"], "left_semi").drop("shard")


def histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy(shard_of(F.col("key")).alias("shard")).agg(F.count("*").alias("n"))


def timeline(admin: DataFrame) -> DataFrame:
    """``grp, shard, idx, op, accepted, state`` after every admin command ``grp, shard, idx, op,
    last``.

    A purge makes a shard gone whatever it was, so it opens a run; within a run the few freezes
    and imports are folded in order.  A freeze leaves gone as it is.  An import is accepted if the
    state is unknown or gone, and its last chunk opens the shard.
    """
    order = Window.partitionBy("grp", "shard").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    runs = admin.withColumn("run", F.sum((F.col("op") == "purge").cast("int")).over(order))
    commands = F.array_sort(F.collect_list(F.struct("idx", "op", F.coalesce("last", F.lit(False)).alias("last"))))
    start = F.struct(F.lit(None).cast("int").alias("state"), F.array().cast("array<struct<idx:bigint,op:string,accepted:boolean,state:int>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        s = acc["state"]
        takes = F.coalesce(s == GONE, F.lit(True))
        accepted = F.when(c["op"] == "import", takes).otherwise(True)
        after = (
            F.when(c["op"] == "purge", F.lit(GONE))
            .when(c["op"] == "freeze", F.when(s == GONE, F.lit(GONE)).otherwise(F.lit(FROZEN)))
            .otherwise(F.when(takes & c["last"], F.lit(OPEN)).otherwise(s))
        )
        row = F.struct(c["idx"].alias("idx"), c["op"].alias("op"), accepted.alias("accepted"), after.alias("state"))
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(row)).alias("out"))

    out = runs.groupBy("grp", "shard", "run").agg(F.aggregate(commands, start, step, lambda a: a["out"]).alias("out"))
    return out.select("grp", "shard", F.explode("out").alias("r")).select("grp", "shard", "r.*")


def _as_of(rows: DataFrame, marks: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` of the last mark ``grp, shard, idx`` before each row's index.

    Marks are spans of indexes; spans and rows meet by shard and by range of indexes, so a row is
    compared with the few spans of its range, and a shard with a third of all rows is many keys."""
    life = Window.partitionBy("grp", "shard").orderBy("idx")
    n, top = marks.agg(F.count("*"), F.coalesce(F.max("idx"), F.lit(0))).collect()[0]
    width = F.lit(max(1, int(top) // (min(n, RANGES) if n > SMALL else 1)))
    last = F.lit(int(top))
    spans = marks.select(F.col("grp").alias("_g"), F.col("shard").alias("_s"), F.col("idx").alias("_from"), F.lead("idx").over(life).alias("_to"), column)
    # Ranges end with the last mark: rows beyond it are all of the last range.
    spans = spans.withColumn("_r", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.coalesce("_to", last) / width))))
    own = rows.withColumn("_range", F.floor(F.least("idx", last) / width))
    on = (F.col("grp") == F.col("_g")) & (F.col("shard") == F.col("_s")) & (F.col("_range") == F.col("_r")) & (F.col("idx") > F.col("_from")) & (F.col("_to").isNull() | (F.col("idx") <= F.col("_to")))
    return own.join(spans, on, "left").drop("_g", "_s", "_r", "_range", "_from", "_to")


def with_state(rows: DataFrame, line: DataFrame) -> DataFrame:
    """Rows ``grp, shard, idx`` with the shard's ``state`` in the group just before them; null if
    it is unknown there."""
    return _as_of(rows, line.where(F.col("state").isNotNull()).select("grp", "shard", "idx", "state"), "state")


def writable(state: Column) -> Column:
    return F.coalesce(state, F.lit(OPEN)) == OPEN


def readable(state: Column) -> Column:
    return F.coalesce(state, F.lit(OPEN)) != GONE


def visible_after_purges(versions: DataFrame, purges: DataFrame) -> DataFrame:
    """Versions ``grp, shard, seq`` that no later purge ``grp, shard, idx`` of their shard has
    deleted: one row a shard is broadcast."""
    last = purges.groupBy("grp", "shard").agg(F.max("idx").alias("_purged"))
    return versions.join(F.broadcast(last), ["grp", "shard"], "left").where(F.col("_purged").isNull() | (F.col("seq") > F.col("_purged"))).drop("_purged")


def replay(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, replies) of a whole log of one or more groups, in index order; each group has indexes
    of its own.

    ``log``: ``grp, idx, client_id, req_seq, op, key, value, expected, shard, kvs, last``.
    State: ``grp, key, value``.  Replies: ``grp, idx, dup, found, value, success, client_id,
    moving, accepted``.  Duplicates are found first, as they don't depend on results; then admin
    commands fold by shard; then keys fold with refused writes left out, imports as puts and
    purges as deletes of the keys that their shard holds.  A refused write is cached in its
    session as refused, so a retry of it is refused too.
    """
    # Commands are marked once: sorting the few clients' rows is the longest step.  Pairs matter for imports only.
    marked = sessions.mark_duplicates(log.withColumn("kvs", F.when(F.col("op") == "import", F.col("kvs")))).persist()
    live = marked.where(~F.col("dup"))
    admin = live.where(F.col("op").isin(*ADMIN))
    line = timeline(admin.select("grp", "shard", "idx", "op", "last")).persist()  # it is read four times
    keyed = live.where(F.col("op").isin("put", "delete", "cas", "get")).withColumn("shard", shard_of(F.col("key")))
    keyed = with_state(keyed.select("grp", "idx", "op", "key", "value", "expected", "shard"), line)
    moving = F.when(F.col("op") == "get", ~readable(F.col("state"))).otherwise(~writable(F.col("state")))
    keyed = keyed.withColumn("moving", moving).persist()  # for commands and for replies

    taken = line.where((F.col("op") == "import") & F.col("accepted")).select("grp", "idx")
    kind = dict(log.dtypes)["value"]
    imported = admin.where(F.col("op") == "import").join(taken, ["grp", "idx"], "left_semi").select("grp", "idx", F.explode("kvs").alias("p"))
    imported = imported.select("grp", "idx", F.lit("put").alias("op"), F.col("p.key").alias("key"), F.col("p.value").alias("value"), F.lit(None).cast(kind).alias("expected"))
    commands = keyed.where(~F.col("moving")).select("grp", "idx", "op", "key", "value", "expected").unionByName(imported)
    # A purge deletes the keys of its shard.  Between two commands of a key, and behind its last one,
    # only the latest purge matters.
    purges = admin.where(F.col("op") == "purge").select("grp", "shard", "idx", F.col("idx").alias("at"))
    placed = commands.select("grp", "idx", "key", shard_of(F.col("key")).alias("shard"))
    placed = placed.withColumn("since", F.lag("idx").over(Window.partitionBy("grp", "key").orderBy("idx")))
    between = _as_of(placed, purges, "at").where(F.col("at") > F.col("since")).select("grp", "key", "at")
    behind = purges.groupBy("grp", "shard").agg(F.max("at").alias("at"))
    ends = placed.groupBy("grp", "key", "shard").agg(F.max("idx").alias("idx")).join(behind, ["grp", "shard"]).where(F.col("at") > F.col("idx"))
    purged = between.unionByName(ends.select("grp", "key", "at"))
    purged = purged.select("grp", F.col("at").alias("idx"), F.lit("purge").alias("op"), "key", F.lit(None).cast(kind).alias("value"), F.lit(None).cast(kind).alias("expected"))
    everything = commands.unionByName(purged).persist()

    state = fold.state(everything).select("grp", "key", "value")
    own = keyed.select("grp", "idx", "moving").join(fold.results(everything), ["grp", "idx"], "left")
    none, no_value = F.lit(False), F.lit(None).cast(kind)
    done = own.select(
        "grp", "idx", F.coalesce("found", none).alias("found"), F.when(~F.col("moving"), F.col("value")).alias("value"), F.coalesce(F.col("success") & ~F.col("moving"), none).alias("success"),
        F.lit(0).cast("long").alias("client_id"), "moving",
    )
    of_admin = line.select("grp", "idx", none.alias("found"), no_value.alias("value"), F.col("accepted").alias("success"), F.lit(0).cast("long").alias("client_id"), none.alias("moving"))
    of_register = live.where(F.col("op") == "register").select("grp", "idx", none.alias("found"), no_value.alias("value"), none.alias("success"), F.col("idx").alias("client_id"), none.alias("moving"))
    results = done.unionByName(of_admin).unionByName(of_register)
    return state, sessions.replies(marked, results, ("found", "value", "success", "client_id", "moving"))


def move(pairs: DataFrame, shard_map: DataFrame, shard: int, to: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(pairs, map, steps) after moving a shard: pairs ``grp, key, value``.

    The steps are those of a move through two logs, for the trace; on an immutable table they are one write:
    the shard's pairs change group.  Moving a shard to its own group does nothing."""
    at = {r.shard: r for r in shard_map.collect()}
    if shard not in at:
        raise ValueError(f"no shard {shard}")
    if at[shard].grp == to and not at[shard].moving:
        return pairs, shard_map, []
    if at[shard].moving not in (0, to):
        raise ValueError(f"shard {shard} is moving to group {at[shard].moving}")
    own = (shard_of(F.col("key")) == shard) & (F.col("grp") == at[shard].grp)
    moved = pairs.withColumn("grp", F.when(own, F.lit(to).cast("long")).otherwise(F.col("grp")))
    flipped = shard_map.withColumn("grp", F.when(F.col("shard") == shard, F.lit(to).cast("long")).otherwise(F.col("grp"))).withColumn("moving", F.when(F.col("shard") == shard, F.lit(0).cast("long")).otherwise(F.col("moving")))
    steps = ["mark", f"freeze@{at[shard].grp}", f"import@{to}", f"purge@{at[shard].grp}", "flip"]
    return moved, flipped, steps


def import_chunks(pairs: DataFrame, max_rows: int = 1000, max_bytes: int = 1 << 20) -> DataFrame:
    """Pairs ``part, key, value`` with the number of their import chunk within the part, in key
    order: a chunk ends before the pair that would exceed either bound.  The count restarts at
    every cut, so it is a streaming pass over sorted partitions, not a window sum."""
    kinds = dict(pairs.dtypes)

    def run(batches):
        import pyarrow as pa

        part, chunk, rows, size = None, 0, 0, 0
        for b in batches:
            out = []
            for p, n in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if p != part:
                    part, chunk, rows, size = p, 0, 0, 0
                if rows >= max_rows or (rows > 0 and size + n > max_bytes):
                    chunk, rows, size = chunk + 1, 0, 0
                rows, size = rows + 1, size + n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(out, pa.int64())], names=["part", "key", "value", "chunk"])

    sized = pairs.select("part", "key", "value", (F.octet_length("key") + F.octet_length("value")).cast("long").alias("n"))
    ordered = sized.repartition("part").sortWithinPartitions("part", "key")
    return ordered.mapInArrow(run, f"part {kinds['part']}, key {kinds['key']}, value {kinds['value']}, chunk long")
