"""Small scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_REQUEST_BYTES = 1 << 20  # keys and values of one request


def quorum(n: Column) -> Column:
    return F.floor(n / 2) + 1


def bench_key(i: Column) -> Column:
    return F.format_string("key%08d", i)


def shard_key(shard: Column) -> Column:
    return F.format_string("mshard/%02d", shard)


def session_key(client_id: Column) -> Column:
    """``s`` and the id as eight big-endian bytes."""
    return F.concat(F.lit(b"s"), F.unhex(F.lpad(F.hex(client_id), 16, "0")))


def internal_key(key: Column, seq: Column, kind: Column) -> Column:
    """Sort key of a version: ascending key, then descending seq; columns, not packed bytes."""
    return F.struct(key.alias("key"), (-seq).alias("newest_first"), kind.alias("kind"))


def fingerprint(term: Column, data: Column) -> Column:
    return F.struct(term.alias("term"), F.xxhash64(data).alias("hash"))


def fixed(x: Column, digits: int) -> Column:
    """x >= 0 with so many digits behind the point, rounded from its exact binary value, half to
    even.  (Spark's own formatting rounds the shortest decimal form, half up.)"""
    p, unit = 10**digits, 1 << 52
    n = F.floor(x)
    part = ((x - n) * F.lit(float(unit))).cast("long") * F.lit(p)
    q, r = F.shiftright(part, 52), part.bitwiseAND(F.lit(unit - 1))
    up = (r > unit >> 1) | ((r == unit >> 1) & ((n * p + q) % 2 == 1))
    total = n * p + q + up.cast("long")
    whole = F.floor(total / p).cast("string") if digits else total.cast("string")
    return F.concat(whole, F.lit("."), F.lpad((total % p).cast("string"), digits, "0")) if digits else whole


def short_number(x: Column) -> Column:
    """Three or four digits and a k or M."""
    return (
        F.when(x >= 1e6, F.concat(fixed(x / 1e6, 1), F.lit("M")))
        .when(x >= 1e3, F.concat(fixed(x / 1e3, 1), F.lit("k")))
        .when(x >= 100, fixed(x, 0))
        .when(x >= 10, fixed(x, 1))
        .otherwise(fixed(x, 2))
    )


def request_bytes(*parts: Column) -> Column:
    """Bytes of a request's keys and values; null counts nothing."""
    total = F.lit(0).cast("long")
    for p in parts:
        total = total + F.coalesce(F.octet_length(p), F.lit(0))
    return total


def fits(*parts: Column) -> Column:
    return request_bytes(*parts) <= MAX_REQUEST_BYTES


def similar(a: Column, b: Column) -> Column:
    """Sizes within a factor of two."""
    return (b <= 2 * a) & (a <= 2 * b)


def cas_holds(found_value: Column, expected: Column) -> Column:
    """Whether a compare-and-swap succeeds; null is absent, on both sides."""
    return found_value.eqNullSafe(expected)
