"""Log segments as text files: one JSON record a line, files in the order of their names.

Only the newest file may end in the middle of a record, as a writer that was stopped leaves it; that
record is cut off.  Anything else that cannot be read is an error, never skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CorruptLog(Exception):
    pass


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of ``schema`` with ``_file`` and ``_line`` (the number of its line,
    from 0), which give their order."""
    names = [x.split()[0] for x in schema.split(", ")]
    lines = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("_file"), F.col("value").alias("_all"))
    lines = lines.select("_file", F.posexplode(F.split("_all", "\n")).alias("_line", "text"), F.endswith("_all", F.lit("\n")).alias("_whole"))
    record = F.from_json("text", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    parsed = lines.where(F.col("text") != "").withColumn("r", record).withColumn("_broken", F.col("r").isNull() | F.col("r._bad").isNotNull())
    newest = lines.agg(F.max(F.struct("_file", "_line")).alias("m")).select("m.*").collect()[0]
    torn = (F.col("_file") == F.lit(newest["_file"])) & (F.col("_line") == F.lit(newest["_line"])) & ~F.col("_whole")
    bad = parsed.where(F.col("_broken") & ~torn).orderBy("_file", "_line").limit(1).collect()
    if bad:
        raise CorruptLog(f"{bad[0]['_file']}, line {bad[0]['_line']}")
    return parsed.where(~F.col("_broken")).select(*(F.col(f"r.{n}").alias(n) for n in names), "_file", "_line")
