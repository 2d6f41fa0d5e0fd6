"""Schemas of the engine's tables.

Keys and values are byte strings, or strings where a caller prefers them; operators only compare
them for equality and in unsigned byte order, which is how Spark compares both.
"""

from __future__ import annotations

from pyspark.sql import types as T

PUT, TOMBSTONE = 1, 0  # kind of a version
OPEN, FROZEN, GONE = 0, 1, 2  # state of a shard in a group; unknown is null
SHARDS = 16

_PAIR = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])

VERSIONS = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("kind", T.ByteType(), False),
    T.StructField("value", T.BinaryType()),
    T.StructField("shard", T.IntegerType()),
])
COMMANDS = T.StructType([
    T.StructField("grp", T.LongType()),
    T.StructField("idx", T.LongType(), False),
    T.StructField("term", T.LongType()),
    T.StructField("entry_type", T.ByteType()),
    T.StructField("client_id", T.LongType()),
    T.StructField("req_seq", T.LongType()),
    T.StructField("op", T.StringType()),  # register put delete cas get scan freeze import purge
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("expected", T.BinaryType()),  # null: must be absent; empty is a value
    T.StructField("scan_start", T.BinaryType()),
    T.StructField("scan_end", T.BinaryType()),
    T.StructField("scan_limit", T.LongType()),
    T.StructField("scan_max_bytes", T.LongType()),
    T.StructField("shard", T.IntegerType()),
    T.StructField("kvs", T.ArrayType(_PAIR)),
    T.StructField("last", T.BooleanType()),
])
STATE = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("seq", T.LongType())])
SHARD_MAP = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("grp", T.LongType()), T.StructField("moving", T.LongType())])
HISTORY = T.StructType([
    T.StructField("client_id", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("expected", T.StringType()),
    T.StructField("absent", T.BooleanType()),
    T.StructField("out_value", T.StringType()),
    T.StructField("out_found", T.BooleanType()),
    T.StructField("out_ok", T.BooleanType()),
    T.StructField("call_ns", T.LongType()),
    T.StructField("return_ns", T.LongType()),
])
TRACE = T.StructType([
    *(T.StructField(c, T.LongType()) for c in ("grp", "node", "event_no", "term")),
    T.StructField("state", T.StringType()),
    *(T.StructField(c, T.LongType()) for c in ("leader", "commit", "applied", "first_idx", "last_idx")),
])
BENCH = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("nodes", T.IntegerType()),
    T.StructField("op", T.StringType()),
    T.StructField("read", T.StringType()),
    T.StructField("value_size", T.IntegerType()),
    T.StructField("clients", T.IntegerType()),
    T.StructField("batched", T.BooleanType()),
    *(T.StructField(c, T.LongType()) for c in ("duration", "ops", "errors")),
    T.StructField("throughput", T.DoubleType()),
    *(T.StructField(c, T.LongType()) for c in ("p50", "p99", "p999")),
])
