"""Ordered fold of put, delete, compare-and-swap and get commands, key by key.

A put or a delete sets a key's state whatever it was.  These commands cut a key's history into
runs: within a run only compare-and-swaps change the state, and a run's first state is known from
the command that opens it.  So what comes before a run's first compare-and-swap needs no fold: it is
carried along sorted rows.  Only the rest of each run is folded in order, so a key with very many
commands is many small groups.  Rests of more than ``LONG_RUN`` commands are folded by a streaming
pass over sorted partitions, in constant memory; the others by a JVM-side ``aggregate``.

A log with a column ``grp`` is that of several groups, each with keys and indexes of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LONG_RUN = 500


def groups_of(log: DataFrame) -> list[str]:
    return ["grp"] if "grp" in log.columns else []


def _runs(log: DataFrame) -> DataFrame:
    """The log with ``run``, ``opened`` (the state that the run's first command left) and ``swaps``
    (compare-and-swaps of the run up to here); purges, if any, open runs too."""
    by = groups_of(log)
    upto = Window.partitionBy(*by, "key").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("op").isin("put", "delete", "purge")
    own = log.select(*by, "key", "idx", "op", "value", "expected")
    own = own.withColumns({"run": F.sum(opens.cast("int")).over(upto), "_all": F.sum((F.col("op") == "cas").cast("int")).over(upto)})
    first = F.struct(F.when(F.col("op") == "put", F.col("value")).alias("value"), F.col("_all").alias("swaps"))
    own = own.withColumn("_open", F.last(F.when(opens, first), ignorenulls=True).over(upto))
    return own.withColumns({"opened": F.col("_open.value"), "swaps": F.col("_all") - F.coalesce("_open.swaps", F.lit(0))}).drop("_open", "_all")


def _step(acc: Column, c: Column) -> Column:
    """State of a key after a command that is no put or delete."""
    return F.when((c["op"] == "cas") & acc.eqNullSafe(c["expected"]), c["value"]).otherwise(acc)


def state(log: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """``key, value`` of every key that exists after the log.

    Everything before a key's last unconditional command is irrelevant; that command is found by a
    partial aggregate, and only compare-and-swaps behind it are gathered, or streamed where there
    are very many."""
    by = groups_of(log)
    at = [*by, "key"]
    opens = log.where(F.col("op").isin("put", "delete", "purge"))
    last = opens.groupBy(*at).agg(F.max(F.struct("idx", F.when(F.col("op") == "put", F.col("value")).alias("value"))).alias("_o"))
    last = last.select(*at, F.col("_o.idx").alias("from_idx"), F.col("_o.value").alias("opened"))
    swaps = log.where(F.col("op") == "cas").select(*at, "idx", "op", "value", "expected").join(last, at, "left")
    swaps = swaps.where(F.col("from_idx").isNull() | (F.col("idx") > F.col("from_idx")))
    settled = last.join(swaps.select(*at).distinct(), at, "left_anti").select(*at, F.col("opened").alias("value"))
    sizes = swaps.groupBy(*at).agg(F.count("*").alias("_n"))
    commands = F.array_sort(F.collect_list(F.struct("idx", "op", "value", "expected")))
    long = sizes.where(F.col("_n") > long_run).select(*at)
    short = swaps
    out = settled
    if not long.isEmpty():
        short = swaps.join(long, at, "left_anti")
        own = _streamed(swaps.join(long, at, "left_semi").withColumn("run", F.lit(0).cast("long")), by, after=True)
        out = out.unionByName(own.groupBy(*at).agg(F.max_by("after", "idx").alias("value")))
    folded = short.groupBy(*at).agg(F.first("opened").alias("_start"), commands.alias("_c"))
    out = out.unionByName(folded.select(*at, F.aggregate("_c", F.col("_start"), _step).alias("value")))
    return out.where(F.col("value").isNotNull())


def results(log: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """``idx, found, value, success`` of every command (and ``grp``, if the log has it): what a get or
    compare-and-swap finds just before it, and whether a write took effect."""
    by = groups_of(log)
    runs = _runs(log)
    reads = F.col("op") == "get"
    plain = runs.where((F.col("swaps") == 0) & (F.col("op") != "purge"))
    out = plain.select(*by, "idx", (reads & F.col("opened").isNotNull()).alias("found"), F.when(reads, F.col("opened")).alias("value"), F.col("op").isin("put", "delete").alias("success"))
    rest = runs.where(F.col("swaps") > 0)
    at = [*by, "key", "run"]
    long = rest.groupBy(*at).agg(F.count("*").alias("_n")).where(F.col("_n") > long_run).select(*at)
    if long.isEmpty():
        return out.unionByName(_short(rest, by))
    own = rest.join(long, at, "left_semi")
    return out.unionByName(_short(rest.join(long, at, "left_anti"), by)).unionByName(_streamed(own, by))


def _short(rest: DataFrame, by: list[str]) -> DataFrame:
    """The rests of runs, from their first compare-and-swap on: gets and compare-and-swaps."""
    kind = dict(rest.dtypes)["value"]
    commands = F.array_sort(F.collect_list(F.struct("idx", "op", "value", "expected")))
    nothing = F.array().cast(f"array<struct<idx:bigint,before:{kind},ok:boolean>>")

    def step(acc: Column, c: Column) -> Column:
        before = acc["state"]
        row = F.struct(c["idx"].alias("idx"), before.alias("before"), ((c["op"] == "cas") & before.eqNullSafe(c["expected"])).alias("ok"))
        return F.struct(_step(before, c).alias("state"), F.concat(acc["out"], F.array(row)).alias("out"))

    gathered = rest.groupBy(*by, "key", "run").agg(F.first("opened").alias("_start"), commands.alias("_c"))
    out = gathered.select(*by, F.aggregate("_c", F.struct(F.col("_start").alias("state"), nothing.alias("out")), step, lambda a: a["out"]).alias("out"))
    out = out.select(*by, F.explode("out").alias("r"))
    return out.select(*by, F.col("r.idx").alias("idx"), F.col("r.before").isNotNull().alias("found"), F.col("r.before").alias("value"), F.col("r.ok").alias("success"))


def _streamed(rest: DataFrame, by: list[str], after: bool = False) -> DataFrame:
    """The same by one pass over partitions sorted by key, run and index; with ``after`` instead the
    key, index and state after each command."""
    kinds = dict(rest.dtypes)
    n_by = len(by)

    def run(batches) -> Iterator:
        import pyarrow as pa

        at, state = None, None
        for b in batches:
            groups = [b.column(i).to_pylist() for i in range(n_by)]
            key, n, idx, op, value, expected, opened = (b.column(n_by + i).to_pylist() for i in range(7))
            found, before, ok, left = [], [], [], []
            for i in range(len(idx)):
                if (here := (*(g[i] for g in groups), key[i], n[i])) != at:
                    at, state = here, opened[i]
                holds = op[i] == "cas" and state == expected[i]
                found.append(state is not None)
                before.append(state)
                ok.append(holds)
                if holds:
                    state = value[i]
                left.append(state)
            kind = b.column(n_by + 4).type
            own = [b.column(i) for i in range(n_by)]
            if after:
                yield pa.RecordBatch.from_arrays([*own, b.column(n_by), pa.array(idx, pa.int64()), pa.array(left, kind)], names=[*by, "key", "idx", "after"])
            else:
                yield pa.RecordBatch.from_arrays([*own, pa.array(idx, pa.int64()), pa.array(found, pa.bool_()), pa.array(before, kind), pa.array(ok, pa.bool_())], names=[*by, "idx", "found", "value", "success"])

    at = [*by, "key", "run"]
    ordered = rest.select(*at, "idx", "op", "value", "expected", "opened").repartition(*at).sortWithinPartitions(*at, "idx")
    head = "".join(f"{c} {kinds[c]}, " for c in by)
    return ordered.mapInArrow(run, head + (f"key {kinds['key']}, idx long, after {kinds['value']}" if after else f"idx long, found boolean, value {kinds['value']}, success boolean"))
