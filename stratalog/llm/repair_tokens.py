"""Token-ID output: Re-Pair grammar compression of encoded documents.

Documents are encoded with a public tokenizer, an end id is appended to each, and the ids are
written in ascending order of document id.  A file row is a *block*: consecutive documents with
a grammar of their own.  Re-Pair replaces frequent pairs of neighbouring symbols by new symbols;
here it works in rounds, each of which replaces every pair that occurs at least ``share`` times
as often as the most frequent one (where two such pairs overlap, the more frequent one), until
no pair occurs ``min_count`` times: rarer ones cost more as a rule than they save (or
``max_rounds`` are done, where it is set).  A symbol never spans two documents.  The block stores
its ids, the rules, the number of ids that each rule expands to, the documents' ids and lengths, and
the remaining symbols, so any range of a document's ids is decoded without expanding the rest
(``decode_range``).

Layout of a block, little-endian: magic ``RPR2``; uint32 documents, rules, symbols, terminals,
bytes a symbol (2 or 4); int64 document ids; uint64 ids a document; uint32 symbols a document;
uint32 ids of the terminals, which are the first symbols; left and right sides of the rules, as
symbols; uint32 expansion lengths; symbols.

Blocks are written as rows of a Parquet table in the shared folder, in any store that Spark
writes to, under Spark's commit protocol; a lost executor's blocks are written anew.

Encoding gives the same ids as ``encode`` of the whole text, but encodes each distinct run of
non-space once a worker (as long as it is remembered): the tokenizer's pieces never span white
space, nor letters and the signs behind them.  Pieces of up to 64 bytes are remembered by a 64-bit
hash.  Texts that hold a special token's string, in letters of either case, are encoded whole.

Defined cases: a null or empty text is the end id alone; a null document id sorts first; repeated
rows are encoded each; ties of the document id are ordered by the text's hash; an empty table
gives no block; other columns are ignored.  A document is held in memory whole.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .store import written

MAGIC = b"RPR2"
BLOCKS = "part int, seq int, n_docs int, n_tokens long, block binary"
NO_ID = -(1 << 63)  # stands for a null document id within a block


@dataclass(frozen=True)
class Settings:
    vocabulary: str = "word_bpe_49k.json"
    end_id: int = 1
    block_tokens: int = 1 << 20
    share: float = 1 / 64
    min_count: int = 5  # the fewest at which a rule of 8 bytes saves more than that, 2 bytes a pair
    max_rounds: int | None = None
    table_bits: int = 22  # of a worker's table of pieces


class PieceTable:
    """Ids by the 64-bit hash of a piece: open addressing in arrays, emptied when it fills up, and
    larger for a document with more pieces than it holds."""

    def __init__(self, bits: int):
        self.least_bits = bits
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.make_room(0)

    def holds(self, more: int) -> bool:
        """Whether so many more pieces leave a quarter of the slots free."""
        return 4 * (self.used + more) <= 3 << self.bits

    def make_room(self, n: int) -> None:
        """Empties the table; it is as large as asked for, or as n pieces need."""
        self.bits = max(self.least_bits, (4 * n // 3 + 1).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.first = np.zeros(1 << self.bits, dtype=np.int64)
        self.count = np.zeros(1 << self.bits, dtype=np.int32)
        self.used = self.n_pool = 0

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Slot of every hash (none is 0); -1 where it isn't known."""
        mask = (1 << self.bits) - 1
        slot = (h >> words.U(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, slot, -1)
        live = np.flatnonzero((key != h) & (key != 0))
        while len(live):
            slot[live] = (slot[live] + 1) & mask
            key = self.keys[slot[live]]
            hit = key == h[live]
            out[live[hit]] = slot[live[hit]]
            live = live[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, ids: list[np.ndarray]) -> None:
        """New, distinct hashes with their ids."""
        mask = (1 << self.bits) - 1
        count = np.array([len(x) for x in ids], dtype=np.int64)
        end = self.n_pool + np.cumsum(count)
        if end[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.n_pool], np.zeros(2 * int(end[-1]) - self.n_pool, dtype=np.uint32)])
        self.pool[self.n_pool : int(end[-1])] = np.concatenate(ids)
        slot = (h >> words.U(64 - self.bits)).astype(np.int64)
        live = np.arange(len(h))
        while len(live):
            free = live[self.keys[slot[live]] == 0]
            claimed, who = np.unique(slot[free], return_index=True)
            won = free[who]
            self.keys[claimed] = h[won]
            self.first[claimed] = end[won] - count[won]
            self.count[claimed] = count[won]
            live = live[self.keys[slot[live]] != h[live]]
            slot[live] = (slot[live] + 1) & mask
        self.used += len(h)
        self.n_pool = int(end[-1])

    def gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these slots in a row, and how many each has."""
        count = self.count[slot].astype(np.int64)
        end = np.cumsum(count)
        at = np.repeat(self.first[slot] - (end - count), count)
        at += np.arange(len(at))
        return self.pool[at], count


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes."""

    SEPARATOR = "0"
    TAIL = ".,;:!?#$%&*|()<>=+-/"
    LONGEST = 64  # bytes of a piece that is looked up by its hash

    def __init__(self, path: str, bits: int = 22):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table = PieceTable(bits)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.separator = self._ids(self.SEPARATOR)
        # Pieces must end at white space, and letters at the signs behind them, for this tokenizer;
        # with another one every text is encoded whole.
        same = all(self.whole(x + y) == self.whole(x) + self.whole(y) for x, y in (("to", " be"), ("to", "."), ("ab", "##"), ("a", "|")))
        same = same and self.whole("Hello World and NASA, ÉCOLE") == self.whole("hello world and nasa, école")
        self.splits = same and len(self.separator) == 1

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def whole(self, text: str) -> bytes:
        return self._ids(text).astype("<u4").tobytes()

    def _encode_pieces(self, pieces: list[str]) -> dict[str, np.ndarray]:
        """Many pieces in one call, told apart by a separator's id that none of them holds."""
        out = {p: self._ids(p) for p in pieces if self.SEPARATOR in p}
        plain = [p for p in pieces if self.SEPARATOR not in p]
        for lo in range(0, len(plain), 2000):
            some = plain[lo : lo + 2000]
            ids = self._ids(f" {self.SEPARATOR} ".join(some))
            cuts = np.flatnonzero(ids == self.separator[0]).tolist()
            if len(cuts) != len(some) - 1:
                out.update((p, self._ids(p)) for p in some)
                continue
            at = 0
            for p, c in zip(some, [*cuts, len(ids)], strict=True):
                out[p] = ids[at:c]
                at = c + 1
        return out

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        """Pieces of letters with signs behind them share what is encoded for the letters."""
        texts = [x.decode("utf-8", "replace") for x in pieces]
        cores = [t.rstrip(self.TAIL) for t in texts]
        # Signs stand apart only from what is letters as the tokenizer sees it.
        tails = [
            t[len(c) :] if len(c) < len(t) and c.isalpha() and (c.isascii() or unicodedata.normalize("NFC", c).lower().isalpha()) else ""
            for c, t in zip(cores, texts, strict=True)
        ]
        heads = [c if tail else t for c, t, tail in zip(cores, texts, tails, strict=True)]
        known = {"": np.empty(0, dtype=np.uint32)}
        some = list({c for c, tail in zip(heads, tails, strict=True) if tail})
        if some:  # letters that have been met without signs
            data = " ".join(some).encode()
            if len(some) == len(own := words.word_hashes(data, fold=False)[0]):
                slot = self.table.slots(np.maximum(own, words.U(1)))
                found = np.flatnonzero(slot >= 0)
                ids, count = self.table.gather(slot[found])
                known |= zip([some[i] for i in found.tolist()], np.split(ids, np.cumsum(count)[:-1]), strict=False)
        known |= self._encode_pieces(list({x for pair in (heads, tails) for x in pair if x not in known}))
        self.table.add(h, [np.concatenate([known[c], known[tail]]) if tail else known[c] for c, tail in zip(heads, tails, strict=True)])

    def _block(self, b: words.Block) -> list[bytes]:
        """Of texts without special tokens."""
        h = np.maximum(b.h, words.U(1))
        long = np.flatnonzero(b.ends - b.starts > self.LONGEST)
        h[long] = words.U(1)  # they are encoded apart
        slot = self.table.slots(h)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, who = np.unique(h[missing], return_index=True)
            if not self.table.holds(len(new)):
                new, who = np.unique(h, return_index=True)
                self.table.make_room(len(new))
                missing = np.arange(len(h))
            where = missing[who]
            self._learn(new, [b"" if k == 1 else b.data[s:e] for k, s, e in zip(new.tolist(), b.starts[where].tolist(), b.ends[where].tolist(), strict=True)])
            slot[missing] = self.table.slots(h[missing])
        ids, count = self.table.gather(slot)
        if len(long):
            apart = [self._ids(b.data[b.starts[i] : b.ends[i]].decode("utf-8", "replace")) for i in long]
            ids = np.insert(ids, np.repeat(np.cumsum(count)[long], [len(x) for x in apart]), np.concatenate(apart))
            count[long] = [len(x) for x in apart]
        data = ids.astype("<u4").tobytes()
        end = np.append(0, np.cumsum(count))[b.first] * 4
        return [data[x:y] for x, y in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        held, odd = [], {}
        for i, t in enumerate(texts):
            t = t or b""
            folded = t.lower()  # only A-Z
            if not self.splits or any(s in t or s in folded for s in self.special):
                odd[i] = self.whole(t.decode("utf-8", "replace"))
                t = b""
            elif not t.isascii():
                # Lower-casing A-Z first saves pieces; it is the same where nothing is composed.
                plain = unicodedata.is_normalized("NFC", t.decode("utf-8", "replace")) and unicodedata.is_normalized("NFC", folded.decode("utf-8", "replace"))
                t = folded if plain else t
            else:
                t = folded
            held.append(t)
        out = [x for b in words.blocks(held, fold=False) for x in self._block(b)]
        for i, x in odd.items():
            out[i] = x
        return out


def _every_second(p: np.ndarray, seq: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of these positions of pairs (x, x) lie at an odd place of a run of x."""
    follows = np.zeros(len(p), dtype=bool)
    follows[1:] = (after[p[:-1]] == p[1:]) & (seq[p[:-1]] == seq[p[1:]])
    begin = np.flatnonzero(~follows)
    return (np.arange(len(p)) - np.repeat(begin, np.diff(np.append(begin, len(p))))) % 2 == 1


def compress(ids: np.ndarray, last: np.ndarray, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, their ``last`` marks, rules (n, 2) and the first nonterminal.  ``last`` marks the
    ids that end a document.

    Symbols are a linked list.  A pair's count is never larger than right after the younger of its
    symbols came to be, so a position whose pair is rare then is not looked at again until one of
    its two symbols is replaced."""
    base, n_rules, rules = int(ids.max()) + 1 if len(ids) else 1, 0, []
    n = len(ids)
    seq = ids.astype(np.uint32)
    kind = np.int32 if n < 1 << 31 else np.int64
    after = np.arange(1, n + 1, dtype=kind)
    after[last] = -1
    after[-1:] = -1
    before = np.full(n, -1, dtype=kind)
    before[after[after >= 0]] = np.flatnonzero(after >= 0)
    live = after >= 0  # positions whose pair may be frequent
    kept = np.ones(n, dtype=bool)
    free = np.int32(np.iinfo(np.int32).max)
    rank = np.full(n + 1, free)  # one more: before the first and behind the last
    rounds = 0
    while s.max_rounds is None or rounds < s.max_rounds:
        rounds += 1
        pos = np.flatnonzero(live)
        left, right = seq[pos].astype(np.uint64), seq[after[pos]].astype(np.uint64)
        same = np.flatnonzero(left == right)
        if len(same):  # pairs that overlap with their likes count once
            taken = np.ones(len(pos), dtype=bool)
            taken[same[_every_second(pos[same], seq, after)]] = False
            pos, left, right = pos[taken], left[taken], right[taken]
        if base + n_rules <= 1 << 16 and n <= 1 << 32:
            number = np.sort(left << words.U(48) | right << words.U(32) | pos.astype(np.uint64))
            code, pos = number >> words.U(32), (number & words.U(0xFFFFFFFF)).astype(np.int64)
            half = 16
        else:
            code, half = left << words.U(32) | right, 32
            order = np.argsort(code, kind="stable")
            code, pos = code[order], pos[order]
        if not len(code):
            break
        edge = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        count = np.diff(np.append(edge, len(code)))
        live[pos[np.repeat(count < s.min_count, count)]] = False
        chosen = count >= max(s.min_count, s.share * count.max())
        if not chosen.any():
            break
        pos, times, code = pos[np.repeat(chosen, count)], count[chosen], code[edge[chosen]]
        by = np.lexsort((code, -times))  # the more frequent first
        place = np.empty(len(by), dtype=np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        own = np.repeat(place, times)
        rank[pos] = own
        take = (own < rank[before[pos]]) & (own < rank[after[pos]])
        rank[pos] = free
        pos, own = pos[take], own[take]
        pays = np.bincount(own, minlength=len(by)) >= s.min_count  # the most frequent pair's always do
        take = pays[own]
        pos, own = pos[take], own[take]
        new = code[by][pays]
        rules.append(np.stack([new >> words.U(half), new & words.U((1 << half) - 1)], axis=1).astype(np.uint32))
        gone = after[pos]
        behind = after[gone]
        seq[pos] = (base + n_rules + np.cumsum(pays) - 1).astype(np.uint32)[own]
        after[pos] = behind
        before[behind[behind >= 0]] = pos[behind >= 0]
        kept[gone] = live[gone] = False
        live[pos] = behind >= 0
        ahead = before[pos]
        live[ahead[ahead >= 0]] = True
        n_rules += len(new)
    return seq[kept], after[kept] < 0, np.concatenate(rules) if rules else np.empty((0, 2), dtype=np.uint32), base


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to; a rule's sides are ids or earlier rules."""
    out = np.zeros(len(rules), dtype=np.uint64)
    known = np.zeros(len(rules), dtype=bool)
    while not known.all():
        def side(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rule = x >= base
            k = np.where(rule, x.astype(np.int64) - base, 0)
            return np.where(rule, out[k], words.U(1)), ~rule | known[k]

        (a, a_known), (b, b_known) = side(rules[:, 0]), side(rules[:, 1])
        new = a_known & b_known & ~known
        out[new] = (a + b)[new]
        known |= new
    return out


def pack(doc_ids: list[int | None], encoded: list[bytes], s: Settings = Settings()) -> bytes:
    """A block of these documents' ids."""
    ids = np.frombuffer(b"".join(encoded), dtype="<u4")
    n_ids = np.array([len(e) // 4 for e in encoded], dtype=np.uint64)
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(n_ids).astype(np.int64) - 1] = True  # each document ends with the end id
    some = np.zeros(int(ids.max()) + 1, dtype=bool)
    some[ids] = True
    terminals = np.flatnonzero(some)
    seq, last, rules, base = compress((np.cumsum(some) - 1)[ids], last, s)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    per_doc = np.diff(np.append(-1, np.flatnonzero(last)))
    return b"".join((
        MAGIC,
        struct.pack("<5I", len(doc_ids), len(rules), len(seq), base, width),
        np.array([NO_ID if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        n_ids.astype("<u8").tobytes(),
        per_doc.astype("<u4").tobytes(),
        terminals.astype("<u4").tobytes(),
        rules.astype(f"<u{width}").tobytes(),
        expansion_lengths(rules, base).astype("<u4").tobytes(),
        seq.astype(f"<u{width}").tobytes(),
    ))


class Reader:
    """Decodes a block."""

    def __init__(self, block: bytes):
        if block[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        n, n_rules, n_symbols, self.base, width = struct.unpack_from("<5I", block, 4)
        at = 24

        def array(kind: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(block, dtype=kind, count=count, offset=at)
            at += x.nbytes
            return x

        self.doc_ids = [None if d == NO_ID else d for d in array("<i8", n).tolist()]
        self.n_ids = array("<u8", n)
        self.first = np.append(0, np.cumsum(array("<u4", n), dtype=np.int64))
        self.terminals = array("<u4", self.base)
        self.rules = array(f"<u{width}", 2 * n_rules).reshape(-1, 2).astype(np.uint32)
        self.lengths = array("<u4", n_rules).astype(np.uint64)
        self.symbols = array(f"<u{width}", n_symbols)
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= self.base
        return np.where(rule, self.lengths[np.where(rule, symbols.astype(np.int64) - self.base, 0)], words.U(1)).astype(np.int64) if len(self.lengths) else np.ones(len(symbols), dtype=np.int64)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of some symbols, unfolding one level of rules at a time."""
        out = symbols.astype(np.uint32)
        while True:
            rule = out >= self.base
            if not rule.any():
                return self.terminals[out]
            size = np.where(rule, 2, 1)
            end = np.cumsum(size)
            wide = np.empty(int(end[-1]), dtype=np.uint32)
            wide[end - size] = np.where(rule, self.rules[np.where(rule, out.astype(np.int64) - self.base, 0), 0], out)
            wide[end[rule] - 1] = self.rules[out[rule].astype(np.int64) - self.base, 1]
            out = wide

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each rule's ids start, and the ids of all rules."""
        if self._flat is None:
            ids = self.expand(np.arange(self.base, self.base + len(self.rules), dtype=np.uint32))
            self._flat = np.append(0, np.cumsum(self.lengths)).astype(np.int64), ids
        return self._flat

    def decode(self) -> np.ndarray:
        """The ids of all documents, in order."""
        if not len(self.rules):
            return self.terminals[self.symbols]
        first, flat = self._table()
        size = self._sizes(self.symbols)
        end = np.cumsum(size)
        rule = self.symbols >= self.base
        # a table of the rules' ids with the symbols' own ids behind it
        source = np.where(rule, first[np.where(rule, self.symbols.astype(np.int64) - self.base, 0)], len(flat) + np.arange(len(rule)))
        at = np.repeat(source - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
        return np.concatenate([flat, self.terminals[np.where(rule, 0, self.symbols)]])[at]

    def decode_range(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the block's document number ``doc``; only symbols that
        overlap the range are expanded."""
        symbols = self.symbols[self.first[doc] : self.first[doc + 1]]
        end = np.cumsum(self._sizes(symbols))
        lo, hi = int(np.searchsorted(end, start, side="right")), int(np.searchsorted(end, stop)) + 1
        skip = start - (int(end[lo - 1]) if lo else 0)
        return self.expand(symbols[lo:hi])[skip : skip + max(0, stop - start)]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(s: Settings) -> Encoder:
    """One a worker process, so that its known pieces serve all its tasks."""
    key = (s.vocabulary, s.table_bits)
    if key not in _ENCODERS:
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[key] = Encoder(s.vocabulary if "/" in s.vocabulary else public_tokenizers.path(s.vocabulary), s.table_bits)
    return _ENCODERS[key]


def encode(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Blocks of the documents' ids: ``part, seq`` give their order."""
    words.small_batches(docs.sparkSession, 400)
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("rid", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange("doc_id", "tie", "rid").sortWithinPartitions("doc_id", "tie", "rid").select("doc_id", "text")

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder = _encoder(s)
        end = np.array([s.end_id], dtype="<u4").tobytes()
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def block():
            nonlocal seq, size
            row = {"part": [part], "seq": [seq], "n_docs": [len(ids)], "n_tokens": [size // 4], "block": [pack(ids, held, s)]}
            seq, size = seq + 1, 0
            ids.clear()
            held.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("block", pa.binary())]))

        for batch in batches:
            for d, e in zip(batch.column(0).to_pylist(), encoder.encode(words.column_bytes(batch, "text")), strict=True):
                if held and size + len(e) + 4 > 4 * s.block_tokens:
                    yield block()
                ids.append(d)
                held.append(e + end)
                size += len(e) + 4
        if held:
            yield block()

    return ordered.mapInArrow(run, BLOCKS)


def index(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, n_symbols`` of every document, read from the blocks."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part, seq, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                r = Reader(block)
                data = memoryview(r.decode().astype("<u4").tobytes())
                end = np.cumsum(r.n_ids).astype(np.int64)
                start = end - r.n_ids.astype(np.int64)
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(r.doc_ids, pa.int64()), pa.array(start, pa.int64()), pa.array(end - start, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.diff(r.first), pa.int64())],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32", "n_symbols"],
                )

    own = blocks.select("part", "seq", "block").mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long, n_symbols long")
    # Ids before each block: before its part (a row a part), and within the part.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("block_start")).join(parts, "part")
    return own.join(starts, ["part", "seq"]).select("doc_id", (F.col("part_start") + F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "n_symbols")


def query(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return index(written(encode(docs, s), "token-blocks"))
