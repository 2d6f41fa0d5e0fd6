"""Shard of a key: 64-bit FNV-1a, an avalanche step, and the top four bits.

Spark has no 64-bit multiplication that wraps, so Arrow batches are hashed in numpy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SHARDS

# Fixed values of the hash.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
AVALANCHE = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def shard_of(key: Column) -> Column:
    """Shard of a key, 0 to 15; a null key is as an empty one.

    Batches of keys are hashed byte position by byte position, all keys at once; the interpreted
    expressions that lambdas of Spark need cost some hundred times as much a key."""

    def shards(keys):
        import numpy as np
        import pyarrow as pa

        keys = keys.cast(pa.large_binary())
        n = len(keys)
        offsets = np.frombuffer(keys.buffers()[1], np.int64, n + 1, keys.offset * 8) if n else np.zeros(1, np.int64)
        data = np.frombuffer(keys.buffers()[2], np.uint8) if keys.buffers()[2] else np.zeros(0, np.uint8)
        start, size = offsets[:-1], np.diff(offsets)
        if keys.null_count:
            size = np.where(np.asarray(keys.is_null()), 0, size)
        h = np.full(n, FNV_OFFSET, np.uint64)
        left, at = np.flatnonzero(size > 0), 0
        while len(left) > 4:
            h[left] = (h[left] ^ data[start[left] + at]) * np.uint64(FNV_PRIME)
            at += 1
            left = left[size[left] > at]
        for i in left:  # a few long keys
            one = int(h[i])
            for byte in data[start[i] + at : start[i] + size[i]].tobytes():
                one = ((one ^ byte) * FNV_PRIME) % (1 << 64)
            h[i] = one
        for factor in AVALANCHE:
            h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
        return pa.array((h >> np.uint64(60)).astype(np.int32))  # h ^= h >> 33 leaves the top bits as they are

    return F.arrow_udf(shards, "int")(key)


def shard_number(key: bytes | str) -> int:
    """The same for one literal key, on the driver."""
    h = FNV_OFFSET
    for byte in key.encode() if isinstance(key, str) else key:
        h = ((h ^ byte) * FNV_PRIME) % (1 << 64)
    for factor in AVALANCHE:
        h = (h ^ (h >> 33)) * factor % (1 << 64)
    return (h ^ (h >> 33)) >> 60


def default_group(shard: Column, groups: list[int]) -> Column:
    """Group of a shard before any move: the sorted groups in turn."""
    return F.element_at(F.array(*(F.lit(g).cast("long") for g in sorted(groups))), (shard % len(groups) + 1).cast("int"))


assert SHARDS == 1 << 4
