"""Sharding: minimax contiguous partition of ordered atomic groups.

Rows with equal texts form a group that no cut divides.  Groups stand in the order of a
128-bit digest of their text (two 64-bit hashes, compared as signed numbers), so a shard is a
range of digests and a row finds its shard by comparing its own digest with the cuts.

The smallest capacity with which ``n`` shards suffice is found by binary search; a capacity is
checked greedily, each shard taking groups up to the capacity.  The check jumps from cut to cut
over prefix sums, so it needs the sums only near the cuts: the driver starts with the sums of
``2**FIRST_BITS`` digest ranges and refines, ``STEP_BITS`` at a time, the few ranges in which a
cut may fall for some capacity between the proven lower and upper bounds, until these ranges
hold one group each.  What the driver holds is bounded by the shard count, never by the rows.
Then the cuts are placed: each as near as possible to an even share of what is left, without
exceeding the smallest capacity in any shard.

Only DataFrame functions are used.  Defined cases: a null text counts as an empty one; empty
texts are one group; repeated rows each get a slot of their own; a group larger than an even
share stands alone where the order allows; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import written

FIRST_BITS, STEP_BITS = 12, 6
ROWS_A_BUCKET = 4000


@dataclass(frozen=True)
class Cut:
    """A shard ends behind the group with this digest."""

    end: int
    k1: int
    k2: int


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, k1, k2, rid`` of every row; ``rid`` tells equal rows apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit("second"), text).alias("k2"),
        F.monotonically_increasing_id().alias("rid"),
    )


class PrefixSums:
    """Sums at the ends of digest ranges, refined where they are asked for."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        #: (bits, range id) -> (bytes, last digest, whether it holds one group only)
        self.ranges = self._sums(F.lit(True), FIRST_BITS)
        self._index()

    def _sums(self, where: Column, bits: int) -> list[tuple]:
        digest = F.struct("k1", "k2")
        got = (
            self.rows.where(where)
            .groupBy(F.shiftright("k1", 64 - bits).alias("at"))
            .agg(F.sum("size").alias("bytes"), F.min(digest).alias("a"), F.max(digest).alias("z"))
            .collect()
        )
        return sorted((tuple(r.z), r.bytes, tuple(r.a) == tuple(r.z), bits, r["at"]) for r in got)

    def _index(self) -> None:
        self.ranges.sort()
        self.ends, at = [], 0
        for r in self.ranges:
            at += r[1]
            self.ends.append(at)
        self.total = at

    def cut(self, k: int) -> Cut:
        return Cut(self.ends[k], *self.ranges[k][0])

    def refine(self, spans: list[tuple[int, int]]) -> bool:
        """Split the ranges that hold several groups and meet one of the byte spans.  False if
        none does: there every end of a group is known."""
        chosen = set()
        for lo, hi in spans:
            k = bisect_right(self.ends, lo)
            while k < len(self.ends) and (self.ends[k - 1] if k else 0) < hi:
                chosen.add(k)
                k += 1
        chosen = {k for k in chosen if not self.ranges[k][2]}
        if not chosen:
            return False
        by_bits: dict[int, list[int]] = {}
        for k in chosen:
            by_bits.setdefault(self.ranges[k][3], []).append(self.ranges[k][4])
        kept = [r for k, r in enumerate(self.ranges) if k not in chosen]
        for bits, ids in by_bits.items():
            kept += self._split(bits, ids)
        self.ranges = kept
        self._index()
        return True

    def _split(self, bits: int, ids: list[int]) -> list[tuple]:
        where = F.shiftright("k1", 64 - bits).isin(ids)
        if bits < 64:
            return self._sums(where, min(64, bits + STEP_BITS))
        got = self.rows.where(F.col("k1").isin(ids)).groupBy("k1", "k2").agg(F.sum("size").alias("bytes")).collect()  # equal first hashes: a handful
        return [((r.k1, r.k2), r.bytes, True, 64, r.k1) for r in got]


def feasible(ends: list[int], n: int, capacity: int) -> bool:
    """Whether taking groups greedily up to ``capacity`` needs at most ``n`` shards."""
    at = 0
    for _ in range(n):
        k = bisect_right(ends, at + capacity) - 1
        if k < 0 or ends[k] <= at:
            return False
        at = ends[k]
        if at == ends[-1]:
            return True
    return False


def smallest(ends: list[int], n: int) -> int:
    """The smallest feasible capacity, by binary search."""
    lo, hi = -(-ends[-1] // n), ends[-1]
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if feasible(ends, n, mid) else (mid + 1, hi)
    return lo


def fair_shares(ends: list[int], n: int) -> tuple[float, list[tuple[int, int]]]:
    """An even share of the bytes besides oversized ranges, and these ranges as byte spans."""
    sizes = sorted(((e - s, s, e) for s, e in zip([0, *ends], ends)), reverse=True)
    big: list[tuple[int, int]] = []
    rest, left = ends[-1], n
    for size, s, e in sizes:
        if left <= 1 or size <= rest / left:
            break
        big.append((s, e))
        rest, left = rest - size, left - 1
    return rest / left, sorted(big)


def place(ends: list[int], n: int, capacity: int) -> list[int]:
    """Indices of the ends to cut at: near even shares, and no shard beyond ``capacity``."""
    latest = [len(ends) - 1]  # backwards: the earliest end from which the later shards suffice
    for _ in range(n - 1):
        latest.append(bisect_left(ends, ends[latest[-1]] - capacity) if ends[latest[-1]] > capacity else -1)
    earliest = latest[::-1]
    _, big = fair_shares(ends, n)
    cuts, at, k = [], 0, -1
    for i in range(n - 1):
        if k == len(ends) - 1:
            break
        later = [b for b in big if b[0] >= at]
        rest = ends[-1] - at - sum(e - s for s, e in later)
        share = rest / max(1, n - i - len(later))
        if later and later[0][0] == at:
            share = later[0][1] - at
        top = bisect_right(ends, at + capacity) - 1
        j = bisect_left(ends, at + share)
        if j > k + 1 and (j >= len(ends) or at + share - ends[j - 1] <= ends[j] - at - share):
            j -= 1
        k = max(k + 1, min(max(j, earliest[i]), top))
        cuts.append(k)
        at = ends[k]
    return cuts


def search(sums: PrefixSums, n: int) -> tuple[int, list[Cut]]:
    """The smallest capacity and the cuts, exact over all groups."""
    while True:
        ends = sums.ends
        hi = smallest(ends, n)  # feasible with some of the ends known, so with all
        lo = max([-(-sums.total // n), *(r[1] for r in sums.ranges if r[2])])
        spans, low, high = [], 0, 0
        for _ in range(n):
            k = bisect_right(ends, low + min(lo, hi)) - 1
            low = ends[k] if k >= 0 and ends[k] > low else low
            high = min(sums.total, high + hi)
            spans.append((low, high))
        cuts = place(ends, n, hi)
        spans = [s for s in spans if s[0] < sums.total] if lo < hi else []
        for k in cuts:  # around the cuts themselves, for evenness
            spans += [(ends[k] - 1, ends[k] + 1)]
        if not sums.refine(spans):
            return hi, [sums.cut(k) for k in place(sums.ends, n, hi)]


def assign(docs: DataFrame, n: int = 24) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``docs``."""
    rows = written(digests(docs), "shard-digests")
    sums = PrefixSums(rows)
    cuts = search(sums, n)[1] if sums.ranges else []
    shard = F.lit(0)
    for c in cuts:
        beyond = (F.col("k1") > c.k1) | ((F.col("k1") == c.k1) & (F.col("k2") > c.k2))
        shard = shard + beyond.cast("int")
    total = sum(r.n for r in rows.groupBy().agg(F.count("*").alias("n")).collect())
    bits = max(4, (total // (n * ROWS_A_BUCKET)).bit_length())
    placed = rows.select("doc_id", "size", "text_crc32", "rid", shard.alias("shard"), F.shiftrightunsigned(F.xxhash64("rid"), 64 - bits).alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("rid"))
    ranked = placed.withColumn("rank", within)
    return ranked.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot")
    )


def query(docs: DataFrame, n: int = 24) -> DataFrame:
    return assign(docs, n).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
