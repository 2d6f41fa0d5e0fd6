"""Continuous apply of a command log: state by key, exactly once.

The stateful form deals keys over ``BUCKETS`` buckets.  A bucket's entry in the state store holds its
keys' values and the last index applied of each; rows of a micro-batch arrive unordered, so they are
sorted by index within the bucket, and an index that is not above its key's last one is skipped, so a
batch that is run again changes nothing.  A micro-batch costs one call a bucket, however many keys
there are, and writes the whole entries of the buckets that it meets.  It emits every command's result.
Input must arrive in index order over micro-batches (ordered files, one log).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LOG = T.StructType([
    T.StructField("idx", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("expected", T.StringType()),
])
RESULT = "key string, idx long, found boolean, value string, success boolean, after string"
STATE = "held string"  # JSON: key, value and last index applied of each
BUCKETS = 1024


def results(log: DataFrame) -> DataFrame:
    """``RESULT`` of every command of a streaming log ``idx, op, key, value, expected``; ``after``
    is the key's value behind the command, null if it is absent."""
    from pyspark.sql import functions as F

    def step(_, frames, state) -> Iterator:
        import json

        import pandas as pd

        held = {k: (v, i) for k, v, i in json.loads(state.get[0])} if state.exists else {}
        out = []
        rows = pd.concat(list(frames)).sort_values("idx")
        for idx, op, key, v, expected in zip(rows.idx.tolist(), rows.op, rows.key, rows.value, rows.expected, strict=True):
            before, applied = held.get(key, (None, 0))
            if idx <= applied:
                continue
            now = before
            expected = None if pd.isna(expected) else expected
            holds = op == "cas" and before == expected
            if op == "put" or holds:
                now = v
            elif op == "delete":
                now = None
            held[key] = (now, idx)
            reads = op in ("cas", "get")
            out.append((key, idx, reads and before is not None, before if reads else None, op in ("put", "delete") or holds, now))
        state.update((json.dumps([(k, *v) for k, v in held.items()]),))
        yield pd.DataFrame(out, columns=["key", "idx", "found", "value", "success", "after"])

    dealt = log.withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    return dealt.groupBy("_bucket").applyInPandasWithState(step, RESULT, STATE, "append", "NoTimeout")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there, into a Parquet table, and returns that table.  Run again
    with the same checkpoint, it goes on behind what it has done."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def last_states(applied: DataFrame) -> DataFrame:
    """``key, value`` of the keys that exist, from the results of a stream."""
    from pyspark.sql import functions as F

    last = applied.groupBy("key").agg(F.max_by(F.struct("after"), "idx").alias("s"))
    return last.select("key", F.col("s.after").alias("value")).where(F.col("value").isNotNull())


def read_log(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """A log of Parquet files, in file order; where a part of the log is several files, a batch must
    take all of them."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_a_batch).parquet(path)
