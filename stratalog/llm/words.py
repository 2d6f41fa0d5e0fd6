"""Vectorised word splitting and hashing over UTF-8 bytes.

A word is a maximal run of bytes other than U+0020 and U+0009 to U+000D.  All of these
separators are single bytes in UTF-8, so splitting bytes and splitting code points agree.
The functions here hold no state and see whole texts; a text of any length is handled in
pieces that end at a separator, so that the working memory stays near ``PIECE`` bytes times a
small factor plus eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U = np.uint64
PIECE = 1 << 20
_MULT = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _table(fold: bool) -> np.ndarray:
    code = np.arange(256, dtype=np.uint64)
    if fold:
        code[65:91] += U(32)
    return mix((code + U(1)) * _MULT)


IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLDED, _EXACT = _table(True), _table(False)
_RATIO = U(0xD6E8FEB86659FD93)
_INVERSE = U(pow(int(_RATIO), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, r in enumerate((_RATIO, _INVERSE)):
            step = np.full(n, r, dtype=np.uint64)
            step[0] = U(1)
            _POWERS[k] = np.cumprod(step, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    space = np.ones(len(buf) + 2, dtype=bool)
    space[1:-1] = IS_SPACE[buf]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


IS_PUNCTUATION = np.zeros(256, dtype=bool)
IS_PUNCTUATION[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


def _stripped(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without ASCII punctuation at their ends; those of nothing else are dropped."""
    starts, ends = starts.copy(), ends.copy()
    for side, at, step in ((ends, -1, -1), (starts, 0, 1)):
        live = np.arange(len(starts))
        while len(live):
            live = live[(starts[live] < ends[live])]
            live = live[IS_PUNCTUATION[buf[side[live] + at]]]
            side[live] += step
    keep = starts < ends
    return starts[keep], ends[keep]


def _piece(buf: np.ndarray, table: np.ndarray, strip: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = spans(buf)
    if strip:
        starts, ends = _stripped(buf, starts, ends)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts, ends
    up, down = _powers(len(buf))
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(table[buf] * up[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * _MULT)), starts, ends


def word_hashes(data: bytes | np.ndarray, fold: bool = True, strip: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of every word; ``fold`` lower-cases A-Z first, ``strip`` takes
    punctuation off its ends and leaves out what is only that."""
    buf = data if isinstance(data, np.ndarray) else np.frombuffer(data, dtype=np.uint8)
    table = _FOLDED if fold else _EXACT
    if len(buf) <= 2 * PIECE:
        return _piece(buf, table, strip)
    parts, at = [], 0
    while at < len(buf):
        end = min(at + PIECE, len(buf))
        while end < len(buf):  # to the last separator, or on to the next one in a very long word
            cut = np.flatnonzero(IS_SPACE[buf[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
                break
            end = min(end + PIECE, len(buf))
        h, s, e = _piece(buf[at:end], table, strip)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


class Block:
    """Some whole documents: their words' hashes, and where each document's words lie.

    ``first[i]:first[i + 1]`` are the words of document i; ``lo + i`` is its row in the batch.
    ``starts`` and ``ends`` are offsets into ``buf``.
    """

    def __init__(self, lo: int, texts: Sequence[bytes], fold: bool, strip: bool = False):
        self.lo, self.n = lo, len(texts)
        self.data = texts[0] if len(texts) == 1 else b"\n".join(texts)
        self.buf = np.frombuffer(self.data, dtype=np.uint8)
        self.h, self.starts, self.ends = word_hashes(self.buf, fold, strip)
        at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.at = at
        self.first = np.searchsorted(self.starts, at).astype(np.int64)
        self.n_words = np.diff(self.first)


def blocks(texts: Sequence[bytes | None], fold: bool = True, target: int = PIECE, strip: bool = False) -> Iterator[Block]:
    """The documents of a batch in blocks of about ``target`` bytes; a longer one stands alone."""
    held: list[bytes] = []
    lo = size = 0
    for i, t in enumerate(texts):
        t = t or b""
        if held and size + len(t) > target:
            yield Block(lo, held, fold, strip)
            held, lo, size = [], i, 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield Block(lo, held, fold, strip)


def windows(b: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word window, and the index of its first word; none crosses documents."""
    n = len(b.h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * U(0xA0761D6478BD642F) + b.h[j : j + n]
    doc = np.repeat(np.arange(b.n), b.n_words)
    keep = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(h[keep] ^ U(k)), keep


def column_bytes(batch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as bytes."""
    import pyarrow as pa

    c = batch.column(batch.schema.get_field_index(name))
    return c.cast(pa.large_binary() if pa.types.is_large_string(c.type) else pa.binary()).to_pylist()


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[IS_SPACE] = 0x20


def shape_hashes(b: Block) -> np.ndarray:
    """Hash of every word's shape: each run of one character class counts once."""
    if not len(b.buf):
        return np.empty(0, dtype=np.uint64)
    shape = _SHAPE[b.buf]
    keep = np.ones(len(shape), dtype=bool)
    np.not_equal(shape[1:], shape[:-1], out=keep[1:])
    return word_hashes(np.ascontiguousarray(shape[keep]), fold=False)[0]


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i + 1]]`` for every i; 0 for an empty one."""
    total = np.zeros(len(values) + 1, dtype=np.float64)
    np.cumsum(values, dtype=np.float64, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def release() -> None:
    """Hands free memory that a worker's allocators hold back to the system, at a task's end: workers
    wait for further tasks, and an executor's share is that of all its workers."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def small_batches(spark, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows in this session, so that long texts fit a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)
