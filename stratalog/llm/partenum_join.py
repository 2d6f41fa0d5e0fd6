"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the distinct hashes of its ``words``-word shingles.  Two sets link when
100 * intersection >= ``percent`` * union.

Signatures.  Sizes are divided into bands so that linked sets lie in one band or in neighbours;
a set takes part in the instance of its own band and in that of the next.  In an instance, linked
sets differ in at most k elements.  The domain of hashes is divided into n1 parts of n2 ranges
each.  At most floor(k / (k2 + 1)) parts hold more than k2 differences, so in some part at most
k2 ranges differ, and the elements in some n2 - k2 of its ranges are the same in both sets.  A
set's signatures are, for each part and each choice of n2 - k2 of its ranges, a hash of the
elements that it has there: linked sets share one.  k2, n1 and n2 are chosen for every instance
so that signatures are few and yet cover several elements.

A choice of ranges in which a set has no element says nothing.  With ``spare`` parts more than
needed, linked sets still share a signature of some elements if one of the two has at most
``spare`` parts where a choice is empty; only sets with more of them also emit their empty
choices.  So nothing is lost, and no signature of nothing gathers a share of all documents.

Candidates.  A signature's hash picks a bucket; the rest of it and a short id of the set's class
(all documents with equal sets) are one 64-bit number, and a bucket is an array of these, sorted
to find the signatures that several classes share.  Classes whose short ids agree are candidates
of each other.  Signatures with the same classes, as near copies have by the dozen, are one list.

Every class has a sketch: bits, a few for each element, that tell whether an odd number of elements
falls on them.  Sets differ in at least as many elements as their sketches in bits, so sketches
rule pairs out exactly.  Within each list all pairs are compared by sketch but those that earlier
ones have connected already; a list of near copies costs about one comparison a class, and lists of
more than ``longest`` classes are cut into blocks of which every two are a list.

Links.  Linked sets lie in one component of the candidates.  Only there sets are shipped and
compared, by products of their incidence matrices over the elements that two of them have.  A
component of more than ``block`` classes is cut into blocks.  For components alone, each block is
compared within and with some hubs of the component; then the classes that the largest part has
not taken in are compared with all others that they may still join, so a family of m copies costs
about m * block comparisons.  ``join`` and ``linked`` compare every two blocks, as a component of
m classes may have m * m / 2 links.

Only documents of candidates have their sets shipped; they are found again by a 128-bit key of id
and text, broadcast if they are at most ``max_broadcast`` rows and joined by shuffle otherwise.
Components are found by label propagation over written tables.  Written tables are dropped once
nothing reads them any more.

Memory: a worker holds a bucket (about ``bucket`` signatures), a bin of lists, or two blocks.  A
signature that many classes share lies in one bucket: 8 bytes a class.

Defined cases: a null or empty text, or one without words, has an empty set and links with
nothing; a text of fewer words than a shingle has one shingle of all its words; repeated rows are
copies; a null id never is a component's id unless all its documents have none; an empty table
gives no rows; other columns are ignored by all but ``deduplicate``, which keeps them.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass
from itertools import combinations
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import components
from .store import Tables, written

U = words.U


@dataclass(frozen=True)
class Settings:
    words: int = 4  # of a shingle
    percent: int = 85
    least: float = 2.5  # elements that a signature of the smallest set covers on average
    bucket: int = 1 << 20  # signatures of a bucket
    flush: int = 1 << 21  # signatures that a task holds before it hands them on
    longest: int = 1 << 14  # classes of a list
    bin: int = 1 << 12  # places in lists that are compared by sketch at once
    block: int = 1024  # classes that are compared with one another at once
    elements: int = 1 << 20  # of a block
    hubs: int = 16  # of a component of several blocks, about
    max_broadcast: int = 400_000


@dataclass(frozen=True)
class Instance:
    """PartEnum parameters for sets of the sizes ``lo`` to ``hi``."""

    number: int
    lo: int
    hi: int
    k: int
    k2: int
    spare: int
    n1: int
    n2: int

    @functools.cached_property
    def choices(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.n2), self.n2 - self.k2))


def band_edges(size: int, percent: int) -> list[tuple[int, int]]:
    """Bands from size 1 to that of ``size``: linked sets lie in one band or in neighbours."""
    out, lo = [], 1
    while lo <= size:
        hi = lo * 100 // percent
        out.append((lo, hi))
        lo = hi + 1
    return out


def _tail(n: int, p: float, most: int) -> float:
    """Probability of more than ``most`` successes among n."""
    if p >= 1:
        return float(n > most)
    term, total = (1 - p) ** n, 0.0
    for i in range(min(most, n) + 1):
        total += term
        term *= (n - i) / (i + 1) * p / (1 - p)
    return max(0.0, 1.0 - total)


@functools.lru_cache(maxsize=4096)
def instance(number: int, lo: int, hi: int, percent: int, least: float = 2.5, rare: float = 1e-4) -> Instance:
    """The fewest signatures such that one covers ``least`` elements of the smallest set on
    average (if k allows) and sets that must emit empty choices are ``rare``."""
    k = 2 * hi * (100 - percent) // (100 + percent)
    best = None
    for k2 in range(4):
        for spare in sorted({int(1.2**i) - 1 for i in range(60) if 1.2**i <= 3 + k / 8}):
            n1 = k // (k2 + 1) + 1 + spare
            for n2 in range(k2 + 1, k2 + (9 if n1 == 1 else 4)):
                share = (n2 - k2) / (n1 * n2)
                empty = min(1.0, math.comb(n2, k2) * (1 - share) ** lo)
                cost = n1 * math.comb(n2, k2)
                ok = lo * share >= least, _tail(n1, empty, spare) <= rare
                rank = (-sum(ok), cost, -share)
                if best is None or rank < best[0]:
                    best = rank, Instance(number, lo, hi, k, k2, spare, n1, n2)
            if best[0][0] == -2:
                break  # more spare parts only cost more
    return best[1]


def instances_of(band: int, edges: list[tuple[int, int]], percent: int, least: float = 2.5) -> list[Instance]:
    """The two instances that a set of this band takes part in."""
    out = []
    for i in (band, band + 1):
        lo = edges[max(0, i - 1)][0]
        out.append(instance(i, lo, edges[i][1], percent, least))
    return out


def shingle_sets(b: words.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a block's documents in a row, and where each begins."""
    h, at = words.windows(b, k)
    cut = np.searchsorted(at, b.first)
    short = np.flatnonzero((b.n_words > 0) & (b.n_words < k))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            some = b.n_words[short] > j
            whole[some] = whole[some] * U(0xA0761D6478BD642F) + b.h[b.first[short[some]] + j]
        h = np.insert(h, cut[short], words.mix(whole ^ b.n_words[short].astype(np.uint64) << U(32)))
        extra = np.zeros(b.n + 1, dtype=np.int64)
        extra[short + 1] = 1
        cut = cut + np.cumsum(extra)
    for i in range(b.n):
        h[cut[i] : cut[i + 1]].sort()
    if not len(h):
        return h, cut
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[cut[:-1][cut[:-1] < cut[1:]]] = True
    return h[fresh], np.append(0, np.cumsum(fresh))[cut]


def signatures(h: np.ndarray, cut: np.ndarray, s: Settings = Settings()) -> list[np.ndarray]:
    """Signatures of every set."""
    flat, owner = owned_signatures(h, cut, s)
    order = np.argsort(owner, kind="stable")
    return np.split(flat[order], np.searchsorted(owner[order], np.arange(1, len(cut) - 1)))


def owned_signatures(h: np.ndarray, cut: np.ndarray, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and the index of the set of each."""
    n = np.diff(cut)
    flat, owner = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    if not len(h):
        return flat[0], owner[0]
    edges = band_edges(int(n.max()) * 2 + 2, s.percent)
    band = np.searchsorted([hi for _, hi in edges], n)
    weight = words.mix(h ^ U(0x5851F42D4C957F2D))
    for number in np.unique(band[n > 0]):
        docs = np.flatnonzero((band == number) & (n > 0))
        own = np.repeat(cut[docs], n[docs]) + np.arange(int(n[docs].sum())) - np.repeat(np.cumsum(n[docs]) - n[docs], n[docs])
        which = np.repeat(np.arange(len(docs)), n[docs])
        total = np.append(U(0), np.cumsum(weight[own], dtype=np.uint64))
        top = h[own] >> U(32)
        for x in instances_of(int(number), edges, s.percent, s.least):
            m = x.n1 * x.n2
            place = (top * U(m) >> U(32)).astype(np.int64) + which * m
            count = np.bincount(place, minlength=len(docs) * m)
            end = np.cumsum(count)
            value = (total[end] - total[end - count]).reshape(len(docs), x.n1, x.n2)
            count = count.reshape(len(docs), x.n1, x.n2)
            empty = ((count == 0).sum(axis=2) >= x.n2 - x.k2).sum(axis=1) > x.spare
            part = words.mix(np.arange(x.n1, dtype=np.uint64) + U(x.number << 32))
            for c, choice in enumerate(x.choices):
                v = value[:, :, choice].sum(axis=2, dtype=np.uint64)
                used = (count[:, :, choice].sum(axis=2) > 0) | empty[:, None]
                flat.append(words.mix(v * U(0x9E3779B97F4A7C15) + part + U(c << 8))[used])
                owner.append(np.repeat(docs, used.sum(axis=1)))
    return np.concatenate(flat), np.concatenate(owner)


def most_signatures(n: np.ndarray, s: Settings) -> np.ndarray:
    """How many signatures sets of these sizes have at most."""
    if not len(n) or not n.max():
        return np.zeros(len(n), dtype=np.int64)
    edges = band_edges(int(n.max()) * 2 + 2, s.percent)
    band = np.searchsorted([hi for _, hi in edges], n)
    out = np.zeros(len(n), dtype=np.int64)
    for number in np.unique(band[n > 0]):
        out[(band == number) & (n > 0)] = sum(x.n1 * len(x.choices) for x in instances_of(int(number), edges, s.percent, s.least))
    return out


def sketches(h: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """A sketch of every set, of two bits an element at least."""
    n = np.diff(cut)
    width = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(n, 1) / 32)).astype(np.int64).clip(0))
    out: list[bytes] = [b""] * len(n)
    for w in np.unique(width[n > 0]):
        docs = np.flatnonzero((width == w) & (n > 0))
        own = np.repeat(cut[docs], n[docs]) + np.arange(int(n[docs].sum())) - np.repeat(np.cumsum(n[docs]) - n[docs], n[docs])
        bit = (h[own] & U(64 * w - 1)).astype(np.int64) + np.repeat(np.arange(len(docs)), n[docs]) * (64 * w)
        odd = (np.bincount(bit, minlength=len(docs) * 64 * w) & 1).astype(bool)
        data = np.packbits(odd, bitorder="little").tobytes()
        for i, d in enumerate(docs.tolist()):
            out[d] = data[8 * w * i : 8 * w * (i + 1)]
    return out


def key(seed: str):
    """One half of a row's key of id and text."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def _digests(h: np.ndarray, cut: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit digest of every set."""
    total = np.append(U(0), np.cumsum(words.mix(h + U((2 * seed + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)), dtype=np.uint64))
    return words.mix(total[cut[1:]] - total[cut[:-1]] + np.diff(cut).astype(np.uint64))


class _Fresh:
    """Which sets a task sees for the first time, as far as it remembers."""

    def __init__(self, most: int = 2_000_000):
        self.seen: set[int] = set()
        self.most = most

    def __call__(self, digests: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(digests), dtype=bool)
        for i, d in enumerate(digests.tolist()):
            out[i] = size[i] > 0 and d not in self.seen
            if len(self.seen) < self.most:
                self.seen.add(d)
        return np.flatnonzero(out)


def _some(h: np.ndarray, cut: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some documents."""
    size = np.diff(cut)[docs]
    own = np.repeat(cut[docs], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return h[own], np.append(0, np.cumsum(size))


ROWS = "doc_id long, k1 long, k2 long, n_words long, n_shingles long, class long, check long, n_sigs long, sketch binary"


def _rows(docs: DataFrame, s: Settings, seed: int, source: bool) -> DataFrame:
    """``ROWS`` of every document (and its source): the row's key, numbers of words and shingles, two
    digests of the set, and, where the task sees the set for the first time, how many signatures it
    has at most and its sketch."""
    words.small_batches(docs.sparkSession)
    more = ["source"] if source else []
    own = docs.select("doc_id", "text", *more).select("doc_id", key("1").alias("k1"), key("2").alias("k2"), "text", *more)

    def run(batches):
        import pyarrow as pa

        first = _Fresh()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for b in words.blocks(words.column_bytes(batch, "text")):
                h, cut = shingle_sets(b, s.words)
                size = np.diff(cut)
                digest = _digests(h, cut, 2 * seed)
                fresh = first(digest, size)
                n_sigs = np.zeros(len(size), dtype=np.int64)
                n_sigs[fresh] = most_signatures(size[fresh], s)
                sketch: list[bytes | None] = [None] * len(size)
                for i, x in zip(fresh.tolist(), sketches(*_some(h, cut, fresh)), strict=True):
                    sketch[i] = x
                for held, x in zip(out, (b.n_words, size, digest.view(np.int64), _digests(h, cut, 2 * seed + 1).view(np.int64), n_sigs), strict=False):
                    held.append(x)
                out[5] += sketch
            columns = [pa.array(np.concatenate(x), pa.int64()) for x in out[:5]]
            names = ["doc_id", "k1", "k2", "n_words", "n_shingles", "class", "check", "n_sigs", "sketch", *more]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, pa.array(out[5], pa.binary()), *batch.columns[4:]], names=names)
        words.release()

    return own.mapInArrow(run, ROWS + (", source string" if source else ""))


HANDED = 1 << 22  # bytes of signatures in a batch that a task hands on


class Short(NamedTuple):
    """Short ids of classes, and the numbers that hold such an id and a part of a signature."""

    bits: int
    buckets: int

    def ids(self, classes: np.ndarray) -> np.ndarray:
        return classes & U((1 << self.bits) - 1)


def _buckets(docs: DataFrame, s: Settings, seed: int, short: Short) -> DataFrame:
    """``bucket, payload``: signatures with short ids, as arrays of 64-bit numbers."""

    def run(batches):
        import pyarrow as pa

        first = _Fresh()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush():
            # No more than three arrays of all numbers at once, and none copied to be handed on.
            numbers, bucket = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            held.clear()
            order = np.argsort(bucket, kind="stable")
            numbers, bucket = numbers[order].astype("<u8", copy=False), bucket[order]
            del order
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            at = np.append(edge, len(numbers)) * 8
            for lo, hi in _spans(np.diff(at), HANDED):
                payload = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((at[lo : hi + 1] - at[lo]).astype(np.int32)), pa.py_buffer(numbers[at[lo] // 8 : at[hi] // 8])])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[lo:hi]].astype(np.int64)), payload], names=["bucket", "payload"])

        for batch in batches:
            for b in words.blocks(words.column_bytes(batch, "text")):
                h, cut = shingle_sets(b, s.words)
                digest = _digests(h, cut, 2 * seed)
                fresh = first(digest, np.diff(cut))
                sig, owner = owned_signatures(*_some(h, cut, fresh), s)
                bucket = (sig >> U(32)) * U(short.buckets) >> U(32)
                held.append(((sig << U(short.bits)) | short.ids(digest[fresh])[owner], bucket.astype(np.uint16 if short.buckets <= 1 << 16 else np.uint32)))
                n += len(sig)
                del sig, owner, bucket
                if n >= s.flush:
                    yield from flush()
                    n = 0
        if n:
            yield from flush()
        words.release()

    return docs.select("text").mapInArrow(run, "bucket long, payload binary")


def _payload_numbers(column) -> np.ndarray:
    """All numbers of a binary column."""
    out = [np.empty(0, dtype="<u8")]
    for c in column.chunks:
        at = np.frombuffer(c.buffers()[1], dtype=np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, dtype=np.int32)
        if len(c):
            out.append(np.frombuffer(c.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].view("<u8"))
    return np.concatenate(out)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each number once."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


LISTS = "hash long, hub long, ids array<long>"


def _lists(buckets: DataFrame, s: Settings, bits: int) -> DataFrame:
    """``LISTS``: the different lists of short ids that share a signature; ``hub`` is the first."""

    def run(table):
        import pyarrow as pa

        numbers = _distinct(_payload_numbers(table.column("payload")))
        sig = numbers >> U(bits)
        edge = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.empty(0, dtype=np.int64)
        size = np.diff(np.append(edge, len(sig)))
        edge, size = edge[size > 1], size[size > 1]
        ids = numbers & U((1 << bits) - 1)
        total = np.append(U(0), np.cumsum(words.mix(ids * U(0x9E3779B97F4A7C15) + U(1)), dtype=np.uint64))
        digest = words.mix(total[edge + size] - total[edge] + size.astype(np.uint64))
        _, who = np.unique(digest, return_index=True)
        digest, edge, size = digest[who], edge[who], size[who]
        out, hashes = [], []
        for e, n, d in zip(edge[size > s.longest].tolist(), size[size > s.longest].tolist(), digest[size > s.longest].tolist(), strict=True):
            parts = np.array_split(ids[e : e + n], -(-2 * n // s.longest))
            pairs = [np.concatenate([parts[i], parts[j]]) for i, j in combinations(range(len(parts)), 2)]
            out += pairs
            hashes += words.mix(U(d) + np.arange(1, len(pairs) + 1, dtype=np.uint64)).tolist()
        plain = size <= s.longest
        digest, edge, size = digest[plain], edge[plain], size[plain]
        own = np.repeat(edge, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat = np.concatenate([ids[own], *out]).view(np.int64)
        at = np.append(0, np.cumsum(np.append(size, [len(x) for x in out]).astype(np.int64)))
        return pa.table({
            "hash": pa.array(np.append(digest, np.array(hashes, dtype=np.uint64)).view(np.int64)), "hub": pa.array(flat[at[:-1]]),
            "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)),
        })

    return buckets.groupBy("bucket").applyInArrow(run, LISTS)


class _Forest:
    """Union-find over numbered classes that remembers the edges that joined two parts."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def roots(self, some: np.ndarray) -> np.ndarray:
        out = self.parent[some]
        while True:
            up = self.parent[out]
            if (up == out).all():
                self.parent[some] = out
                return out
            out = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the two of each pair."""
        x, y = self.roots(a), self.roots(b)
        live = np.flatnonzero(x != y)
        nodes, at = np.unique(np.concatenate([x[live], y[live]]), return_inverse=True)
        i, j = at[: len(live)], at[len(live) :]
        label = np.arange(len(nodes))
        while True:
            least = label.copy()
            np.minimum.at(least, i, label[j])
            np.minimum.at(least, j, label[i])
            least = least[least]
            if (least == label).all():
                break
            label = least
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        self.parent[nodes[moved]] = nodes[label[moved]]
        self.edges += zip(nodes[moved].tolist(), nodes[label[moved]].tolist(), strict=True)


GATHERED = 1 << 18  # words of the sketches of pairs that are compared at once, on each side


class _Sketches:
    """Lower bounds of the differences of numbered classes."""

    def __init__(self, n: np.ndarray, data: list[bytes], percent: int):
        self.n, self.percent = n, percent
        self.width = np.array([len(x) // 8 for x in data], dtype=np.int64)
        self.place = np.zeros(len(data), dtype=np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            who = np.flatnonzero(self.width == w)
            self.place[who] = np.arange(len(who))
            self.rows[w] = np.frombuffer(b"".join(data[i] for i in who.tolist()), dtype="<u8").reshape(-1, w)

    @staticmethod
    def _folded(rows: np.ndarray, w: int) -> np.ndarray:
        while rows.shape[1] > w:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        return rows

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of classes."""
        most = (self.n[a] + self.n[b]) * (100 - self.percent)
        out = np.abs(self.n[a] - self.n[b]) * (100 + self.percent) <= most
        live = np.flatnonzero(out)
        code = self.width[a[live]] * (1 << 32) + self.width[b[live]]
        for c in np.unique(code).tolist():
            x, y = c >> 32, c & 0xFFFFFFFF
            w = min(x, y)
            at = live[code == c]
            for lo in range(0, len(at), 1 + GATHERED // w):
                some = at[lo : lo + 1 + GATHERED // w]
                p, q = (self._folded(self.rows[v][self.place[z[some]]], w) for v, z in ((x, a), (y, b)))
                out[some] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64) * (100 + self.percent) <= most[some]
        return out


SMALL, PAIRS = 24, 1 << 20  # classes of a list all of whose pairs are taken at once; pairs held


def connect(lists: list[np.ndarray], sketch: _Sketches, forest: _Forest) -> None:
    """Joins the classes of each list that may link, directly or through others."""
    codes, held, n = [], 0, len(sketch.n)

    def settle(more: np.ndarray | None = None):
        nonlocal held
        if more is not None:
            codes.append(more)
            held += len(more)
        if codes and (more is None or held > PAIRS):
            code = _distinct(np.concatenate(codes))
            a, b = code // n, code % n
            hit = sketch.may_link(a, b)
            forest.join(a[hit], b[hit])
            codes.clear()
            held = 0

    def codes_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a, b) * n + np.maximum(a, b)

    for own in sorted((x for x in lists if len(x) > SMALL), key=len, reverse=True):
        # With the first one, which joins near copies at once; then what is still apart, in pairs
        # whose sizes allow a link.
        for k in (0, len(own) // 2):
            part = forest.roots(own)
            others = own[part != part[k]]
            hit = others[sketch.may_link(np.full(len(others), own[k]), others)]
            forest.join(np.full(len(hit), own[k]), hit)
        part = forest.roots(own)
        if (part == part[0]).all():
            continue
        order = np.argsort(sketch.n[own], kind="stable")
        own, part = own[order], part[order]
        size = sketch.n[own]
        end = np.searchsorted(size, size * 100 // sketch.percent, side="right")
        count = end - np.arange(len(own)) - 1
        for lo, hi in _spans(count, PAIRS):
            i = np.repeat(np.arange(lo, hi), count[lo:hi])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count[lo:hi]) - count[lo:hi], count[lo:hi])
            apart = part[i] != part[j]
            settle(codes_of(own[i[apart]], own[j[apart]]))
    size = np.array([len(x) for x in lists], dtype=np.int64)
    for k in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
        i, j = np.triu_indices(k, 1)
        some = np.flatnonzero(size == k)
        for lo in range(0, len(some), 1 + PAIRS // len(i)):
            own = np.stack([lists[x] for x in some[lo : lo + 1 + PAIRS // len(i)].tolist()])
            settle(codes_of(own[:, i], own[:, j]).ravel())
    settle()


def _spans(count: np.ndarray, most: int):
    """Ranges of rows with about ``most`` in all."""
    total = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


EDGES = "a long, b long"


def _candidates(lists: DataFrame, classes: DataFrame, s: Settings, tables: Tables) -> DataFrame:
    """``EDGES`` that join all classes that share a signature and may link."""
    n_places = lists.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n")).collect()[0].n
    bins = max(1, -(-n_places // s.bin))
    # Lists of one hub are compared together; those of a hub with very many places are spread.
    hot = lists.groupBy("hub").agg(F.ceil(F.sum(F.size("ids")) / F.lit(s.bin)).alias("parts")).where("parts > 1")
    own = lists.join(hot, "hub", "left").withColumn("bin", F.pmod(F.xxhash64("hub", F.pmod("hash", F.coalesce("parts", F.lit(1)))), F.lit(bins)))
    own = tables.written(own.select("bin", "hash", "ids"), "lists")
    places = own.select(F.col("bin").alias("of"), F.explode("ids").alias("id")).distinct()
    members = places.join(classes.select("id", "class", "n_shingles", "sketch"), "id")

    def run(left, right):
        import pyarrow as pa

        ids, cls, n = (right.column(c).to_numpy() for c in ("id", "class", "n_shingles"))
        data = right.column("sketch").to_pylist()
        order = np.argsort(ids, kind="stable")
        lists, seen = [], set()
        flat_ids = ids[order]
        for h, x in zip(left.column("hash").to_pylist(), left.column("ids"), strict=True):
            if h in seen:
                continue
            seen.add(h)
            x = x.values.to_numpy()
            begin, end = np.searchsorted(flat_ids, x), np.searchsorted(flat_ids, x, side="right")
            size = end - begin
            lists.append(order[np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)])
        forest = _Forest(len(cls))
        connect(lists, _Sketches(n, data, s.percent), forest)
        edges = np.array(forest.edges, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(cls[edges[:, 0]], pa.int64()), "b": pa.array(cls[edges[:, 1]], pa.int64())})

    found = own.groupBy("bin").cogroup(members.groupBy("of")).applyInArrow(run, EDGES)
    # Classes with one short id are one in the lists.
    same = classes.groupBy("id").agg(F.min("class").alias("a"), F.count("*").alias("n")).where("n > 1").select("id", "a")
    clash = classes.join(same, "id").select("a", F.col("class").alias("b")).where("a != b")
    out = tables.written(found.unionByName(clash), "candidates")
    tables.drop(own)
    return out


def _elements(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """``class, elements`` of the wanted rows (class, k1, k2)."""
    own = docs.select("doc_id", "text").select(key("1").alias("k1"), key("2").alias("k2"), "text")
    few = wanted.limit(s.max_broadcast + 1).count() <= s.max_broadcast
    own = own.join(F.broadcast(wanted) if few else wanted, ["k1", "k2"]).select("class", "text")

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()  # repeated rows have one key
        for batch in batches:
            cls = batch.column(0).to_numpy()
            for b in words.blocks(words.column_bytes(batch, "text")):
                h, cut = shingle_sets(b, s.words)
                new = []
                for i, c in enumerate(cls[b.lo : b.lo + b.n].tolist()):
                    if c not in seen:
                        seen.add(c)
                        new.append(i)
                new = np.array(new, dtype=np.int64)
                flat, at = _some(h, cut, new)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(cls[b.lo + new], pa.int64()), lists], names=["class", "elements"])
        words.release()

    return own.mapInArrow(run, "class long, elements array<long>")


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of the sets ``left`` (rows) with the sets ``right``."""
    if len(left) == 1 and len(right) <= 4:
        own = sets[left[0]]
        return np.array([[len(own) if j == left[0] else len(np.intersect1d(own, sets[j], assume_unique=True)) for j in right]], dtype=np.int64)
    both = np.unique(np.concatenate([left, right]))
    flat = np.concatenate([sets[i] for i in both])
    owner = np.repeat(np.arange(len(both)), [len(sets[i]) for i in both])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    edge = np.append(True, flat[1:] != flat[:-1])
    times = np.diff(np.append(np.flatnonzero(edge), len(flat)))
    shared = np.repeat(times > 1, times)  # others lie in no intersection but a set's with itself
    owner, column = owner[shared], (np.cumsum(edge[shared]) - 1)
    x, y = np.searchsorted(both, left), np.searchsorted(both, right)
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    n_columns = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, n_columns, columns):
        a, z = np.searchsorted(column, [lo, lo + columns])
        block = np.zeros((len(both), min(columns, n_columns - lo)), dtype=np.float32)
        block[owner[a:z], column[a:z] - lo] = 1
        out += (block[x] @ block[y].T).astype(np.int64)
    return out


def _compare(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of the linked sets of side 0 among each other, or of side 1 with those of side 2
    (each pair once), and the sizes of their intersections."""
    square = np.flatnonzero(side == 0)
    left, right = (square, square) if len(square) else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    if not len(left) or not len(right) or (len(square) == 1):
        return (np.empty(0, dtype=np.int64),) * 3
    if len(square) == 2:
        left, right = square[:1], square[1:]
    n = np.array([len(x) for x in sets], dtype=np.int64)
    both = intersections(sets, left, right)
    hit = (100 + percent) * both >= percent * (n[left][:, None] + n[right][None, :])
    if len(square) > 2:
        hit &= np.arange(len(right)) > np.arange(len(left))[:, None]
    i, j = np.nonzero(hit)
    return left[i], right[j], both[i, j]


GROUP = ["g", "lo", "hi"]


def _groups(table):
    """Of a group's table: component, indexes of its rows, their sets and sides."""
    import pyarrow as pa

    lists = table.column("elements")
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    values, cut = lists.values.to_numpy(), lists.offsets.to_numpy()
    comp, cls, side = (table.column(c).to_numpy() for c in ("component", "class", "side"))
    order = np.lexsort((side, cls, comp))
    c, k, x = comp[order], cls[order], side[order]
    fresh = np.append(True, (c[1:] != c[:-1]) | (k[1:] != k[:-1]) | (x[1:] != x[:-1])) if len(c) else np.empty(0, dtype=bool)
    order = order[fresh]  # a class may have been shipped by several tasks, and a hub is in a block too
    for own in np.split(order, np.flatnonzero(comp[order][1:] != comp[order][:-1]) + 1) if len(order) else []:
        yield own, [values[cut[i] : cut[i + 1]] for i in own], side[own]


def _sized(members: DataFrame, s: Settings) -> DataFrame:
    """The members (class, n_shingles, component) with ``n_blocks`` of their component."""
    size = F.greatest(F.ceil(F.count("*") / F.lit(s.block)), F.ceil(F.sum("n_shingles") / F.lit(s.elements))).cast("int")
    return members.join(members.groupBy("component").agg(size.alias("n_blocks")), "component")


def _placed(sized: DataFrame, s: Settings, every: bool) -> DataFrame:
    """The sized members in groups to be compared: small components together; large ones by blocks
    with some hubs, or by every two blocks."""
    total = sized.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).collect()[0].n
    bins = max(1, -(-total // s.elements))
    keep = ["class", "component", "n_shingles"]
    small = sized.where("n_blocks = 1").select(*keep, F.pmod(F.xxhash64("component"), F.lit(bins)).alias("g"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.lit(0).alias("side"))
    block = F.pmod(F.xxhash64("class"), F.col("n_blocks")).cast("int")
    large = sized.where("n_blocks > 1").withColumn("block", block)
    each = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    if every:
        side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
        large = large.select(*keep, "block", each).select(*keep, F.col("component").alias("g"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), side.alias("side"))
        return small.unionByName(large)
    hub = F.pmod(F.xxhash64("class", F.lit("hub")), F.col("n_blocks") * s.block) < s.hubs
    own = large.select(*keep, F.col("component").alias("g"), F.col("block").alias("lo"), F.col("block").alias("hi"), F.lit(0).alias("side"))
    hubs = large.where(hub).select(*keep, "block", each).where("block != other").select(*keep, F.col("component").alias("g"), F.col("other").alias("lo"), F.col("other").alias("hi"), F.lit(0).alias("side"))
    return small.unionByName(own).unionByName(hubs)


def _forest(placed: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """``class, links, root``: links of the class with others of its group, and a class that they
    lead to (itself if none)."""

    def run(table):
        import pyarrow as pa

        cls = table.column("class").to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        for own, sets_, side in _groups(table):
            i, j, _ = _compare(sets_, side, s.percent)
            forest = _Forest(len(own))
            forest.join(i, j)
            weight = table.column("docs").to_numpy()[own] if "docs" in table.column_names else np.ones(len(own), dtype=np.int64)
            links = np.zeros(len(own), dtype=np.int64)
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            for held, x in zip(out, (cls[own], links, cls[own][forest.roots(np.arange(len(own)))]), strict=True):
                held.append(x)
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in zip(("class", "links", "root"), out, strict=True)})

    return placed.join(sets.hint("merge"), "class").groupBy(*GROUP).applyInArrow(run, "class long, links long, root long")


class Resolved(NamedTuple):
    rows: DataFrame  # doc_id, k1, k2, n_words, n_shingles, class[, source]
    classes: DataFrame  # class, n_shingles, least, docs, best, component[, links]
    members: DataFrame  # class, n_shingles, docs, component of the candidates
    sets: DataFrame  # class, elements of the candidates
    tables: Tables


def _classed(docs: DataFrame, s: Settings, tables: Tables, source: bool) -> tuple[DataFrame, DataFrame, int]:
    """Rows and classes, with a seed of the digests that tells all sets apart."""
    seed = 0
    while True:
        rows = tables.written(_rows(docs, s, seed, source), "documents")
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("best")
        size = F.max("n_shingles").alias("n_shingles")
        other = ((F.min("check") != F.max("check")) | (F.min("n_shingles") != F.max("n_shingles"))).alias("mixed")
        classes = rows.where("n_shingles > 0").groupBy("class").agg(size, F.min("doc_id").alias("least"), F.count("*").alias("docs"), F.max("n_sigs").alias("n_sigs"), best, F.max("sketch").alias("sketch"), other)
        classes = tables.written(classes, "classes")
        if classes.where("mixed").isEmpty():
            return rows.drop("check", "n_sigs", "sketch"), classes, seed
        tables.drop(rows, classes)
        seed += 1


def _resolve(docs: DataFrame, s: Settings, every: bool = False, source: bool = False) -> Resolved:
    """Components of all classes of equal sets, and the links of each if ``every`` is set."""
    tables = Tables(docs.sparkSession)
    rows, classes, seed = _classed(docs, s, tables, source)
    n_classes, n_sigs = classes.agg(F.count("*"), F.coalesce(F.sum("n_sigs"), F.lit(0))).collect()[0]
    short = Short(max(32, n_classes.bit_length() + 8), max(1, -(-n_sigs // s.bucket)))
    classes = classes.withColumn("id", F.col("class").bitwiseAND(F.lit((1 << short.bits) - 1)))

    lists = tables.written(_lists(_buckets(docs, s, seed, short), s, short.bits), "shared-signatures")
    edges = _candidates(lists, classes, s, tables)
    labels = components(edges)
    of = classes.join(labels, classes["class"] == labels.node)
    members = tables.written(of.select("class", "n_shingles", "docs", "component", "best.k1", "best.k2"), "candidate-classes")
    tables.drop(lists, edges)
    sets = tables.written(_elements(docs, members.select("class", "k1", "k2"), s), "sets")
    sized = _sized(members.select("class", "n_shingles", "docs", "component"), s)
    placed = _placed(sized, s, every)
    if every:
        placed = placed.join(members.select("class", "docs"), "class")
    found = tables.written(_forest(placed, sets, s), "links")
    links = found.where("class != root").select(F.col("class").alias("a"), F.col("root").alias("b"))
    if not every:
        links = _remaining(sized.where("n_blocks > 1").drop("docs"), sets, links, s, tables)
    labels = components(links)
    classes = classes.drop("component").join(labels, classes["class"] == labels.node, "left").withColumn("component", F.coalesce("component", "class")).drop("node")
    if every:
        counts = found.groupBy("class").agg(F.sum("links").alias("links"))
        classes = classes.join(counts, "class", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    classes = tables.written(classes.drop("sketch", "mixed", "n_sigs", "id"), "components")
    tables.drop(found)
    return Resolved(rows, classes, members, sets, tables)


def _remaining(large: DataFrame, sets: DataFrame, links: DataFrame, s: Settings, tables: Tables) -> DataFrame:
    """The links, and those that are missing to connect large components: classes outside a
    component's largest part are compared with all of its classes."""
    if large.isEmpty():
        return links
    labels = components(links)
    parts = large.join(labels.withColumnRenamed("component", "part"), large["class"] == labels.node, "left").withColumn("part", F.coalesce("part", "class")).drop("node")
    parts = tables.written(parts, "parts")
    sizes = parts.groupBy("component", "part").agg(F.count("*").alias("n"))
    rest = sizes.groupBy("component").agg(F.max(F.struct("n", "part")).alias("largest"), F.sum("n").alias("n"))
    rest = rest.where("largest.n < n").select("component", F.col("largest.part").alias("main"), (F.col("n") - F.col("largest.n")).alias("others"), "n")
    own = tables.written(parts.join(rest, "component"), "open-components")
    if own.isEmpty():
        return links
    # As many blocks of the others as their share of the component's blocks.
    n_left = F.ceil(F.col("others") / F.col("n") * F.col("n_blocks")).cast("int")
    own = own.withColumns({"block": F.pmod(F.xxhash64("class"), F.col("n_blocks")).cast("int"), "n_left": n_left})
    own = own.withColumn("row", F.pmod(F.xxhash64("class", F.lit("left")), F.col("n_left")).cast("int"))
    keep = ["class", "component", "n_shingles", F.col("component").alias("g")]
    left = own.where("part != main").select(*keep, F.col("row").alias("lo"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("hi"), F.lit(1).alias("side"))
    right = own.select(*keep, F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("lo"), F.col("block").alias("hi"), F.lit(2).alias("side"))
    found = tables.written(_forest(left.unionByName(right), sets, s), "more-links")
    return links.unionByName(found.where("class != root").select(F.col("class").alias("a"), F.col("root").alias("b")))


def _documents(r: Resolved, *more: str) -> DataFrame:
    """Every class to its component, and every document to its class."""
    smallest = r.classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = r.classes.join(smallest, "component").select("class", "component_id", "component", *more)
    none = F.col("n_shingles") == 0
    out = r.rows.withColumn("class", F.when(~none, F.col("class"))).join(classes, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component", "k1", "k2", *more)


def clusters(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id, component, k1, k2`` of every document; ``component_id``
    is the smallest id that links lead to, ``component`` a number of its own for every component
    (null for an empty set), and k1 and k2 are a key of the row's id and text."""
    r = _resolve(docs, s)
    r.tables.drop(r.sets, r.members)
    return _documents(r)


def sized_clusters(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, size, source, cluster`` of every document: its words, and the number of its component
    (null for an empty set), which is the smallest digest of a set there and no order of rows changes."""
    r = _resolve(docs, s, source=True)
    r.tables.drop(r.sets, r.members)
    of = F.when(F.col("n_shingles") > 0, F.col("class"))
    out = r.rows.withColumn("class", of).join(r.classes.select("class", F.col("component").alias("cluster")), "class", "left")
    return out.select("doc_id", F.col("n_words").alias("size"), "source", "cluster")


def join(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """All links between classes of equal sets: ``a, b, n_a, n_b, n_both`` (a < b, set sizes and
    intersection), and the class of every document: ``doc_id, n_shingles, class, k1, k2`` (null for
    an empty set).  Documents of one class, and of two linked ones, are all that link."""
    r = _resolve(docs, s)

    def run(table):
        import pyarrow as pa

        cls = table.column("class").to_numpy()
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for own, sets_, side in _groups(table):
            i, j, both = _compare(sets_, side, s.percent)
            n = np.array([len(x) for x in sets_], dtype=np.int64)
            swap = cls[own][i] > cls[own][j]
            a, b = np.where(swap, j, i), np.where(swap, i, j)
            for held, x in zip(out, (cls[own][a], cls[own][b], n[a], n[b], both), strict=True):
                held.append(x)
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in zip(("a", "b", "n_a", "n_b", "n_both"), out, strict=True)})

    placed = _placed(_sized(r.members.select("class", "n_shingles", "component"), s), s, True)
    links = placed.join(r.sets.hint("merge"), "class").groupBy(*GROUP).applyInArrow(run, "a long, b long, n_a long, n_b long, n_both long")
    of = F.when(F.col("n_shingles") > 0, F.col("class")).alias("class")
    return r.tables.written(links, "all-links"), r.rows.select("doc_id", "n_shingles", of, "k1", "k2")


def linked(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every document; ``n_links`` is the number of
    other documents that it links with, copies included."""
    r = _resolve(docs, s, every=True)
    r.tables.drop(r.sets, r.members)
    out = _documents(r._replace(classes=r.classes.withColumn("n_links", F.col("docs") - 1 + F.col("links"))), "n_links")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


#: Near copies, as the pipeline takes them.
NEAR = Settings(words=5, percent=80, least=4.0)


def deduplicate(docs: DataFrame, s: Settings = NEAR) -> DataFrame:
    """One document of each component, the one with the smallest id, with all columns of ``docs``;
    documents with an empty set stay."""
    r = _resolve(docs, s)
    r.tables.drop(r.sets, r.members)
    # The first row of every component, found over classes: no group is one task.
    first = r.classes.groupBy("component").agg(F.min("best").alias("best")).select("best.k1", "best.k2")
    shown = r.rows.where("n_shingles > 0").select("k1", "k2")
    others = written(shown.join(first, ["k1", "k2"], "left_anti").distinct(), "copies")
    repeated = written(shown.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")), "repeated-rows")
    keyed = docs.withColumns({"_k1": key("1"), "_k2": key("2")})
    other = others.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    few = other.limit(s.max_broadcast + 1).count() <= s.max_broadcast
    kept = keyed.join(F.broadcast(other) if few else other, ["_k1", "_k2"], "left_anti")
    if not repeated.isEmpty():  # rows with equal id and text: one of them
        once = kept.join(repeated, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
        kept = kept.join(repeated, ["_k1", "_k2"], "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def query(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return clusters(docs, s).select("doc_id", "n_shingles", "component_id")
