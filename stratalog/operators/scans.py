"""Limits on ordered scans: by pairs, by bytes, over shards, and in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import versions as V


def pair_bytes(key: str = "key", value: str = "value") -> Column:
    return (F.octet_length(key) + F.octet_length(value)).cast("long")


def bounded(pairs: DataFrame, limit: int = 0, max_bytes: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """The first pairs in key order: at most ``limit``, and up to and including the pair with
    which keys and values reach ``max_bytes``.  0 is no bound.  ``by`` scans groups apart.

    With only a limit this is a top-k.  A byte bound needs running sums: as every pair has at
    least a byte, at most ``max_bytes`` pairs of a range can count, so the top-k comes first and
    the window runs over its result.
    """
    columns = pairs.columns
    if not by:
        most = min(x for x in (limit, max_bytes) if x > 0) if limit > 0 or max_bytes > 0 else 0
        if most:
            pairs = pairs.orderBy("key").limit(most)
        if max_bytes <= 0:
            return pairs.orderBy("key")
    order = Window.partitionBy(*by).orderBy("key")
    own = pairs.withColumn("_before", F.coalesce(F.sum(pair_bytes()).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("_n", F.row_number().over(order))
    if limit > 0:
        own = own.where(F.col("_n") <= limit)
    if max_bytes > 0:
        own = own.where(F.col("_before") < max_bytes)
    return own.select(*columns).orderBy(*by, "key")


def merged(groups: DataFrame, limit: int = 0, max_bytes: int = 0, compat_per_group_bound: bool = False) -> DataFrame:
    """One ordered scan over the pairs ``grp, key, value`` of several groups.

    The bounds hold for the whole result.  ``compat_per_group_bound`` applies the byte bound to
    every group apart and not again afterwards, as a plain router does: then a key may be missing
    below another group's last one.
    """
    if compat_per_group_bound:
        own = bounded(groups, limit, max_bytes, by=("grp",))
        return bounded(own, limit).select("key", "value")
    return bounded(groups, limit, max_bytes).select("key", "value")


def page(versions: DataFrame, after=None, limit: int = 1000, as_of: int | None = None) -> DataFrame:
    """The pairs that follow the key ``after``: a cursor, not an offset."""
    v = versions if after is None else versions.where(F.col("key") > F.lit(after))
    return bounded(V.newest(v, as_of), limit)


def fit_batch(entries: DataFrame, max_entries: int, max_bytes: int, by: tuple[str, ...] = ("grp",)) -> DataFrame:
    """The prefix of each group's entries ``idx, size`` within both caps; the first always goes."""
    order = Window.partitionBy(*by).orderBy("idx")
    own = entries.withColumn("_n", F.row_number().over(order)).withColumn("_sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return own.where((F.col("_n") <= max_entries) & ((F.col("_sum") <= max_bytes) | (F.col("_n") == 1))).drop("_n", "_sum")


def scan_commands(scans: DataFrame, versions: DataFrame) -> DataFrame:
    """``idx, key, value`` of scan commands ``idx, scan_start, scan_end, scan_limit,
    scan_max_bytes``, each over the state just before its index.

    Keys are cut into ranges of about ``SCAN_KEYS`` keys.  A range is a sweep over its versions and
    scans in the order of their indexes, which holds the range's live keys and nothing else; a range of
    more than ``SWEEP_ROWS`` rows is cut by its indexes too, and a version is copied to every part
    that it lives into.  A scan starts in the range of its first key; one that its bounds have not
    filled goes on to twice as many ranges as before, so a scan with a small limit reads few keys, and
    the rounds are as many as the logarithm of the number of ranges.  What goes on is checkpointed, so
    the plan of a round does not hold those before it.
    """
    from ..schema import PUT

    n_keys = versions.agg(F.approx_count_distinct("key")).collect()[0][0]
    edges = _edges(versions, min(MOST_RANGES, n_keys // SCAN_KEYS))
    v = versions.where(F.col("key").isNotNull()).select("key", "value", (F.col("kind") == PUT).alias("put"), F.col("seq").cast("long").alias("at"))
    v = _ranged(v, "key", edges).persist()

    limit, most = F.coalesce("scan_limit", F.lit(0)).cast("long"), F.coalesce("scan_max_bytes", F.lit(0)).cast("long")
    ends = F.when(F.length("scan_end") > 0, F.col("scan_end"))
    todo = scans.select(F.col("idx").cast("long").alias("at"), F.coalesce("scan_start", F.lit("")).alias("key"), ends.alias("hi"), F.when(limit > 0, limit).alias("left"), F.when(most > 0, most).alias("bytes"))
    todo = _ranged(_ranged(todo, "key", edges), "hi", edges, "_e").where(F.col("_r") <= F.col("_e"))
    # Without bounds all ranges are read at once.
    todo = todo.withColumn("_upto", F.when(F.col("left").isNull() & F.col("bytes").isNull(), F.col("_e")).otherwise(F.col("_r")))
    todo = todo.withColumn("_r", F.explode(F.sequence("_r", "_upto"))).persist()

    parts = _parts(v, todo)
    dealt = _timed(v, parts, lives=True)
    blank = {"hi": "string", "left": "long", "bytes": "long", "_e": "int", "_upto": "int"}
    dealt = dealt.select("_r", "_t", "at", F.lit(1).alias("_v"), "key", "value", "put", *(F.lit(None).cast(t).alias(c) for c, t in blank.items()))
    out, step, read = None, 1, [v, todo]
    while True:
        own = _timed(todo, parts).select("_r", "_t", "at", F.lit(0).alias("_v"), "key", F.lit(None).cast("string").alias("value"), F.lit(False).alias("put"), *blank)
        hit = _swept(dealt.unionByName(own), alone=step == 1)
        if step > 1:
            order = Window.partitionBy("idx").orderBy("_r", F.col("key").asc_nulls_last())
            hit = hit.withColumn("_n", F.row_number().over(order) - 1).withColumn("_before", F.coalesce(F.sum(pair_bytes()).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            hit = hit.withColumns({"left": F.col("left") - F.col("_n"), "bytes": F.col("bytes") - F.col("_before")}).where((F.col("left").isNull() | (F.col("left") > 0)) & (F.col("bytes").isNull() | (F.col("bytes") > 0)))
            hit = hit.drop("_n", "_before")
        hit = hit.persist()
        found = hit.where(F.col("key").isNotNull()).select("idx", "key", "value")
        out = found if out is None else out.unionByName(found)
        # Rows without a key are scans that go on behind the last range read.
        step *= 2
        more = _cut(hit.where(F.col("key").isNull()))
        if more.isEmpty():
            for x in read:
                x.unpersist()
            return out
        upto = F.least(F.col("_r") + F.lit(step), F.col("_e"))
        todo = more.select(F.col("idx").alias("at"), F.lit("").alias("key"), F.col("value").alias("hi"), "left", "bytes", "_e", upto.alias("_upto"), F.explode(F.sequence(F.col("_r") + 1, upto)).alias("_r"))


SCAN_KEYS = 1024  # of a range of keys, about
MOST_RANGES = 4096
SWEEP_ROWS = 250_000  # of a sweep, about
TIMES = 1024  # parts of a range of keys, at most


def _edges(versions: DataFrame, ranges: int) -> list[str]:
    """First keys of all ranges but the first, from a bounded sample; they decide how rows are dealt,
    never what is found."""
    if ranges <= 1:
        return []
    sample = versions.groupBy("key").agg(F.lit(1).alias("_")).orderBy(F.xxhash64("key")).select("key").limit(16 * MOST_RANGES)
    keys = sorted(r.key for r in sample.collect() if r.key is not None)
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _ranged(rows: DataFrame, column: str, edges: list[str], name: str = "_r") -> DataFrame:
    """The rows with the number of edges that are not above the column; null is above all."""
    if not edges:
        return rows.withColumn(name, F.lit(0))
    names = rows.columns
    kinds = rows.schema

    def run(batches):
        import bisect

        import pyarrow as pa

        at = names.index(column)
        for b in batches:
            place = [len(edges) if x is None else bisect.bisect_right(edges, x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int32())], names=[*names, name])

    return rows.mapInArrow(run, T.StructType([*kinds.fields, T.StructField(name, T.IntegerType())]))


def _cut(rows: DataFrame) -> DataFrame:
    """The rows without their plan: an adaptive plan that holds a persisted one shows it twice, so
    plans over persisted tables double with each."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.localCheckpoint()


def _parts(versions: DataFrame, scans: DataFrame) -> DataFrame | None:
    """``_r, _parts, _from, _width`` of the ranges that are cut by indexes; None if there are none."""
    n = F.least(F.ceil(F.count("*") / F.lit(SWEEP_ROWS)), F.lit(TIMES)).cast("long")
    sizes = versions.select("_r", "at").unionByName(scans.select("_r", "at")).groupBy("_r").agg(n.alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    cut = [(r._r, r.n, r.lo, -(-(r.hi - r.lo + 1) // r.n)) for r in sizes.where("n > 1 AND hi > lo").collect()]  # MOST_RANGES rows at most
    return versions.sparkSession.createDataFrame(cut, "_r int, _parts long, _from long, _width long") if cut else None


def _timed(rows: DataFrame, parts: DataFrame | None, lives: bool = False) -> DataFrame:
    """The rows with ``_t``, their part; with ``lives``, each put in every part that it lives into."""
    if parts is None:
        return rows.withColumn("_t", F.lit(0).cast("long"))

    def part(at: Column) -> Column:
        t = F.floor((at - F.col("_from")) / F.col("_width"))
        return F.least(F.greatest(t, F.lit(0).cast("long")), F.col("_parts") - 1)

    whole = rows.join(F.broadcast(parts.select("_r")), "_r", "left_anti").withColumn("_t", F.lit(0).cast("long"))
    own = rows.join(F.broadcast(parts), "_r")
    if lives:
        own = own.withColumn("_until", F.lead("at").over(Window.partitionBy("key").orderBy("at")))
        last = F.when(~F.col("put"), part(F.col("at"))).when(F.col("_until").isNull(), F.col("_parts") - 1).otherwise(part(F.col("_until")))
        own = own.withColumn("_t", F.explode(F.sequence(part(F.col("at")), last)))
    else:
        own = own.withColumn("_t", part(F.col("at")))
    return whole.unionByName(own.select(*whole.columns))


def _swept(rows: DataFrame, alone: bool) -> DataFrame:
    """``idx, key, value`` of what the scans find in each range, within their bounds, and a row without
    a key for every scan that goes on (its end as ``value``).  With ``alone`` a scan reads one range,
    and ``left`` and ``bytes`` are what its bounds leave; else those that it came with."""

    def run(batches):
        from bisect import bisect_left, insort

        import pyarrow as pa

        kinds = pa.schema([("idx", pa.int64()), ("key", pa.string()), ("value", pa.string()), ("left", pa.int64()), ("bytes", pa.int64()), ("_r", pa.int32()), ("_e", pa.int32())])
        here, keys, held, out = None, [], {}, []

        def batch():
            done = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
            out.clear()
            return done

        for b in batches:
            for r, t, at, is_version, key, value, put, hi, left, most, end, upto in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (r, t) != here:
                    here, keys, held = (r, t), [], {}
                if is_version:
                    if put:
                        if key not in held:
                            insort(keys, key)
                        held[key] = value
                    elif key in held:
                        del held[key]
                        del keys[bisect_left(keys, key)]
                    continue
                n = size = 0
                i = bisect_left(keys, key)
                while i < len(keys) and (left is None or n < left) and (most is None or size < most):
                    k = keys[i]
                    if hi is not None and k >= hi:
                        break
                    v = held[k]
                    out.append((at, k, v, left, most, r, end))
                    i, n = i + 1, n + 1
                    if most is not None and v is not None:
                        size += len(k.encode()) + len(v.encode())
                    if len(out) >= 10_000:
                        yield batch()
                if r == upto < end:  # so its end is in no range read yet
                    if not alone:
                        out.append((at, None, hi, left, most, r, end))
                    elif (left is None or n < left) and (most is None or size < most):
                        out.append((at, None, hi, None if left is None else left - n, None if most is None else most - size, r, end))
                if len(out) >= 10_000:
                    yield batch()
        if out:
            yield batch()

    ordered = rows.select("_r", "_t", "at", "_v", "key", "value", "put", "hi", "left", "bytes", "_e", "_upto").repartition("_r", "_t").sortWithinPartitions("_r", "_t", "at", "_v")
    return ordered.mapInArrow(run, "idx long, key string, value string, left long, bytes long, _r int, _e int")
