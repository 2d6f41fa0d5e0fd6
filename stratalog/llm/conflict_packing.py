"""Best-fit packing with conflicts.

Documents are packed into bins of ``capacity`` words.  A bin never holds two documents of one
duplicate cluster (near copies by links of 0.8 over five-word shingles, see ``partenum_join``), nor
more than ``per_source`` of one source (by default one).  A document longer than the capacity is
cut into full pieces and a rest; its pieces are of one cluster and source, so they lie in different
bins.

Within a packing group the pieces are placed in descending order of size (ties: cluster, then
document, then piece).  Open bins stand in one list ordered by what is left in them, and carry
bitmaps of the sources and clusters that they hold.  A piece starts at the successor of its size,
the tightest bin it fits into, and goes on to looser bins until one has no conflict; if none has,
a new bin is opened.  The search is not cut off.

Long runs of incompatible bins are skipped exactly: bins are also kept in one ordered list for
each set of sources, and a set that already holds the piece's source is not searched at all; only
clusters remain to be compared bin by bin.

The groups are packed in parallel.  A row's group is the hash of its id, size, source and cluster, so
the bins are a function of the table, whatever its order and partitions.  A source or a cluster with
a third of all rows is spread over all groups, which are of about ``group_rows`` rows however large
the input is.  A group costs at most a few bins that could be fuller.

Defined cases: a null or empty text is a piece of size 0; a null source conflicts with no other; a
null cluster (``conflicts`` input) conflicts with none; repeated rows share a cluster; an empty
table gives no bins; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import partenum_join
from .store import written


@dataclass(frozen=True)
class Settings:
    capacity: int = 2048
    per_source: int = 1
    group_rows: int = 4_000


def best_fit(sizes: list[int], sources: list[int | None], clusters: list[int | None], capacity: int, per_source: int = 1) -> tuple[list[int], list[int]]:
    """Bin of every piece, and what is left in every bin.  Pieces come in placing order; sources
    and clusters are small numbers, the bits of the bitmaps."""
    left: list[int] = []
    source_map: list[int] = []  # bitmap of sources that are full in the bin
    cluster_map: list[int] = []
    held: list[dict[int, int]] = []
    lists: dict[int, list[tuple[int, int]]] = {}  # bitmap of full sources -> (left, bin), ordered
    where = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s_bit = 1 << source if source is not None else 0
        c_bit = 1 << cluster if cluster is not None else 0
        best = None
        for full, bins in lists.items():
            if full & s_bit:
                continue
            k = bisect_left(bins, (size, -1))
            while k < len(bins) and (best is None or bins[k] < best):
                if not cluster_map[bins[k][1]] & c_bit:
                    best = bins[k]
                    break
                k += 1
        if best is None:
            b = len(left)
            left.append(capacity)
            source_map.append(0)
            cluster_map.append(0)
            held.append({})
        else:
            b = best[1]
            bins = lists[source_map[b]]
            del bins[bisect_left(bins, best)]
            if not bins:
                del lists[source_map[b]]
        left[b] -= size
        cluster_map[b] |= c_bit
        if source is not None:
            held[b][source] = held[b].get(source, 0) + 1
            if held[b][source] >= per_source:
                source_map[b] |= s_bit
        insort(lists.setdefault(source_map[b], []), (left[b], b))
        where.append(b)
    return where, left


def _numbers(values: list) -> list[int | None]:
    seen: dict = {}
    return [None if v is None else seen.setdefault(v, len(seen)) for v in values]


def pack_group(rows: list[tuple], s: Settings) -> list[tuple]:
    """(doc, piece, pieces, size, bin, left) of rows (doc, size, source, cluster)."""
    pieces = []
    for i, (doc, size, source, cluster) in enumerate(rows):
        full, rest = divmod(size, s.capacity)
        n = full + (rest > 0 or full == 0)
        own = cluster if cluster is not None else ("row", i) if n > 1 else None
        for k in range(n):
            pieces.append((s.capacity if k < full else rest, own, doc, k, n, source, i))
    pieces.sort(key=lambda p: (-p[0], str(p[1]), p[2] is None, p[2] or 0, p[3]))
    where, left = best_fit([p[0] for p in pieces], _numbers([p[5] for p in pieces]), _numbers([p[1] for p in pieces]), s.capacity, s.per_source)
    return [(p[2], p[3], p[4], p[0], b, left[b]) for p, b in zip(pieces, where, strict=True)]


PACKED = "doc_id long, piece int, n_pieces int, size long, pack_group int, bin int, bin_left long"


def pack(items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``PACKED`` of rows ``doc_id, size, source, cluster``."""
    n = sum(r.n for r in items.groupBy().agg(F.count("*").alias("n")).collect())
    groups = max(1, -(-n // s.group_rows))
    own = items.select("doc_id", F.col("size").cast("long").alias("size"), "source", F.col("cluster").cast("string").alias("cluster"))
    own = own.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "size", "source", "cluster"), F.lit(groups)).cast("int"))

    def run(key, table):
        import pyarrow as pa

        cols = [table.column(c).to_pylist() for c in ("doc_id", "size", "source", "cluster")]
        out = pack_group(list(zip(*cols, strict=True)), s)
        doc, piece, n_pieces, size, b, left = zip(*out, strict=True)
        g = np.full(len(doc), key[0].as_py(), dtype=np.int32)
        return pa.table({
            "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "n_pieces": pa.array(n_pieces, pa.int32()),
            "size": pa.array(size, pa.int64()), "pack_group": pa.array(g), "bin": pa.array(b, pa.int32()), "bin_left": pa.array(left, pa.int64()),
        })

    return own.groupBy("pack_group").applyInArrow(run, PACKED)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source, cluster``: words of the whole text, and as cluster the digest of the text
    with case and white space evened out, so exact copies but for these share one."""
    text = F.coalesce("text", F.lit(""))
    even = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    words = F.when(even == "", 0).otherwise(F.char_length(even) - F.char_length(F.replace(even, F.lit(" "), F.lit(""))) + 1)
    return docs.select("doc_id", words.cast("long").alias("size"), "source", F.md5(even).alias("cluster"))


def query(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Bins of all documents, with near copies as clusters; texts without words are one cluster."""
    own = partenum_join.sized_clusters(docs, partenum_join.NEAR)
    own = own.withColumn("cluster", F.coalesce(F.col("cluster").cast("string"), F.lit("none")))
    return pack(written(own, "sized-documents"), s)
