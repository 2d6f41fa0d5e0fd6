"""Chat formatting: cumulative-snapshot collapse, then rendering.

A log that is written after every turn holds each conversation many times over, as prefixes of
its final form.  Every turn gets the rolling hash of the conversation up to and including it, 128 bits.
A conversation whose last value is an earlier value of another conversation is a prefix of that
one, and an anti-join on (length, value) drops it.  Of conversations with the same turns the one
with the smallest id stays.  What remains is rendered as one text.

Only digests are shuffled for the hashes; texts are shuffled once, for conversations that stay,
to be rendered.  The join's right side is reduced to distinct values before it is shuffled, so a
first turn that a third of all conversations share costs one row a task.

Only DataFrame functions are used.  Defined cases: turns are ordered by (turn, role, digest), nulls
first, and repeated rows are repeated turns; a null role renders as ``unknown`` and equals only a
null role; a null text renders as an empty one but differs from it in the chain; a row without a
conversation id belongs to no conversation and is left out; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TEMPLATE = "<|{role}|>\n{text}\n<|end|>\n"  # one turn, as rendered


def _turn_digest(seed: str) -> Column:
    """Of role and text; a null is hashed as a mark that no value can equal."""
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def chains(turns: DataFrame) -> DataFrame:
    """One row a turn: ``conv_id, n, n_turns, value``, where ``value`` is the rolling hash of the
    conversation's first ``n`` turns.

    Every turn is hashed together with its position, and the hash rolls by adding the 32-bit
    halves of these, so a prefix's value is a running sum and no turns are gathered in a row.
    """
    own = turns.where(F.col("conv_id").isNotNull()).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", _turn_digest("a").alias("a"), _turn_digest("b").alias("b"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "a", "b").rowsBetween(Window.unboundedPreceding, 0)
    placed = own.withColumn("n", F.row_number().over(order))
    lanes = [(F.xxhash64("n", x), half) for x in ("a", "b") for half in (0, 1)]
    sums = [F.sum(F.shiftrightunsigned(h, 32) if half else h.bitwiseAND(F.lit(0xFFFFFFFF))).over(order).alias(f"s{i}") for i, (h, half) in enumerate(lanes)]
    n_turns = F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns")
    return placed.select("conv_id", "n", n_turns, F.struct("n", *sums).alias("value"))


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies`` of the conversations that no other one prolongs."""
    c = chains(turns)
    whole = c.where(F.col("n") == F.col("n_turns")).groupBy("value").agg(F.min("conv_id").alias("conv_id"), F.max("n_turns").alias("n_turns"), F.count("*").alias("n_copies"))
    prefixes = c.where(F.col("n") < F.col("n_turns")).select("value").distinct()
    return whole.join(prefixes, "value", "left_anti").select("conv_id", "n_turns", "n_copies")


def render(turns: DataFrame, kept: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, n_turns, n_copies, rendered`` of the kept conversations."""
    head, mid = template.split("{role}")
    mid, tail = mid.split("{text}")
    turn = F.concat(F.lit(head), F.coalesce("role", F.lit("unknown")), F.lit(mid), F.coalesce("text", F.lit("")), F.lit(tail))
    rows = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), "role", _turn_digest("a").alias("a"), _turn_digest("b").alias("b"), turn.alias("r")).alias("t"))
    own = rows.join(kept, "conv_id")
    return (
        own.groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.sort_array(F.collect_list("t")).alias("ts"))
        .select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.array_join(F.col("ts")["r"], "").alias("rendered"))
    )


def query(turns: DataFrame) -> DataFrame:
    return render(turns, maximal(turns))


SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
    role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, n, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY n) AS turns FROM t),
whole AS (
  SELECT turns, min(conv_id) AS conv_id, max(n_turns) AS n_turns, count(*) AS n_copies FROM p WHERE n = n_turns GROUP BY turns),
kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = w.turns AND p.n < p.n_turns))
SELECT k.conv_id, k.n_turns, k.n_copies,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY n) AS rendered
FROM kept k JOIN t USING (conv_id) GROUP BY ALL
"""
