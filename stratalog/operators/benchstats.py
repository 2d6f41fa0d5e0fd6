"""Benchmark statistics: rank percentiles, throughput, gaps, timelines, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

# Buckets of the request and fsync histograms.
FIRST_BUCKET, REQUEST_BUCKETS, FSYNC_BUCKETS = 0.0001, 16, 12


def at_rank(ordered: Column, share: tuple[int, int]) -> Column:
    """The element at 0-based rank floor(n * p) of a sorted array; p is a fraction of integers."""
    n = F.size(ordered)
    return F.get(ordered, F.floor(n * share[0] / share[1]).cast("int"))


RANKS = {"p50": (1, 2), "p99": (99, 100), "p999": (999, 1000)}


def latency(samples: DataFrame, by: str, value: str) -> DataFrame:
    """``ops, p50, p99, p999`` of each group, by rank.

    Ranks come from counts of distinct values, not from gathered samples: values are counted with
    partial aggregation, and a window over the counts finds where the running count passes each
    rank."""
    counts = samples.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    own = ordered.running_sum(counts, [by], "_v", F.col("_n"), "_upto")
    totals = counts.groupBy(F.col(by).alias("_by")).agg(F.sum("_n").alias("_all"))
    own = own.join(totals, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    picks = [F.min(F.when(F.col("_upto") > F.floor(F.col("_all") * a / b), F.col("_v"))).alias(name) for name, (a, b) in RANKS.items()]
    return own.groupBy(by).agg(F.max("_all").alias("ops"), *picks)


def throughput(samples: DataFrame, by: str, start: Column, end: Column) -> DataFrame:
    """Operations a second of each group; start and end in nanoseconds."""
    span = (F.max(end) - F.min(start)) / F.lit(1e9)
    return samples.groupBy(by).agg(F.count("*").alias("ops"), F.try_divide(F.count("*"), span).alias("throughput"))


def longest_gap(successes: DataFrame, by: str, t: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Longest time between consecutive successes of each group, among gaps that meet the window
    from ``since`` to ``until``."""
    own = ordered.previous(successes, [by], t, {"_before": t})
    if since is not None:
        own = own.where(F.col(t) >= since)
    if until is not None:
        own = own.where(F.col("_before").isNull() | (F.col("_before") <= until))
    return own.groupBy(by).agg(F.max(F.col(t) - F.col("_before")).alias("gap"))


def buckets(successes: DataFrame, t: str, width: int, duration: int) -> DataFrame:
    """``bucket, n`` of tumbling buckets, empty ones included: duration / width + 1 of them."""
    counts = successes.groupBy(F.floor(F.col(t) / width).alias("bucket")).agg(F.count("*").alias("n"))
    cells = successes.sparkSession.range(duration // width + 1).select(F.col("id").alias("bucket"))
    return cells.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(samples: DataFrame, by: str, value: str, n_buckets: int = REQUEST_BUCKETS) -> DataFrame:
    """``le, n``: samples up to each of the exponential bounds, cumulative, by group; one pass."""
    bounds = [FIRST_BUCKET * 2**i for i in range(n_buckets)]
    counts = samples.groupBy(by).agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)))
    cells = F.array(*(F.struct(F.lit(i).alias("bucket"), F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)))
    return counts.select(by, F.explode(cells).alias("c")).select(by, "c.bucket", "c.le", "c.n")


def series(results: DataFrame, rows: str, columns: str, value: str, values: list | None = None) -> DataFrame:
    """A chart's series: one column a value of ``columns``."""
    return results.groupBy(rows).pivot(columns, values).agg(F.first(value))
