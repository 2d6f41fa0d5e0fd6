"""Benchmark decontamination by templates.

Words are canonicalised: punctuation at their ends is dropped, letters are lower-cased, numbers become
``<number>``, a unit behind a number ``<unit>``, and a run of capitalised words (not those in capitals
only) ``<name>``; what a placeholder stands for is its slot's value.  A capitalised word that begins a
sentence may be a name or not, so texts are taken in two forms: in the first such words are plain, in
the second they are names.  Every window of ``Settings.window`` tokens of a document's form is looked
up among the windows of the benchmark items in the same form.  A window with fewer than
``min_literal`` plain words says too little as a template; it is looked up by its words themselves,
slots included, so a verbatim copy of a list of names and numbers is found and a re-parameterised one
is not.

Matching windows of one document and one item on one alignment (same distance between the two
positions) make an occurrence.  It is contamination if

* it covers ``min_words`` tokens in a row, or ``min_share`` of the item, and
* its slots are consistent: equal slot values of the item meet equal values in the document, in
  at least ``min_consistent`` of the slots.

So a question with other numbers and names in the same places is caught, and a text that only
shares a template's shape with unrelated fillings of its repeated slots is not.  Occurrences in the
second form are reported where they are contamination and none in the first form is.

The lookup is a hash join whose small side is broadcast in blocks: the items are divided, by hash
of their id, so that no block has more than ``max_index_words`` words.  With several blocks, one pass
over the documents keeps those that have a window of any block, by a bitmap of fixed size, and only
these are read again for each block.  Nothing of the documents is shuffled, so a source or passage
with a third of all rows is no more work than another.

Defined cases: null or empty texts match nothing; an item of fewer than ``min_literal`` tokens is
never found, verbatim copies included; an item shorter than the window is one window of its own
length; equal items are each reported; repeated rows are reported each; an item's id may be of any
type that Arrow has as number or string; no items means no rows; other columns are ignored by
``find`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from . import words
from .store import written

U = words.U

# Units that may follow a number, and numbers written as words.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t gram grams kilogram kilograms ton tons tonne tonnes oz ounce ounces lb lbs pound pounds"
    " ml cl l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years"
    " cent cents dollar dollars euro euros usd eur percent degree degrees c f k w kw kwh mb gb tb hz khz mhz ghz v mph kmh kph"
)
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
    " twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
)
NUMBER, NAME, UNIT = (words.mix(np.array([x], dtype=np.uint64))[0] for x in (0xA1, 0xA2, 0xA3))


def _hash_list(text: str) -> np.ndarray:
    return np.sort(words.word_hashes(text.encode())[0])


_UNITS, _NUMBERS = _hash_list(UNITS), _hash_list(NUMBERS)


@dataclass(frozen=True)
class Settings:
    window: int = 8
    min_literal: int = 4
    min_words: int = 13
    min_share: float = 0.5
    min_consistent: float = 0.75
    max_index_words: int = 1_000_000  # of one broadcast block: 48 MB
    filter_bits: int = 28  # of the bitmap of all windows, if there are several blocks: 32 MB


def _among(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)] == h


def _lowered(t: bytes) -> bytes:
    """The text in lower case, in as many bytes; letters that would take more or fewer stay."""
    low = (text := t.decode("utf-8", "replace")).lower().encode()
    if len(low) != len(t):
        low = "".join(x if len((x := c.lower()).encode()) == len(c.encode()) else c for c in text).encode()
    return low if len(low) == len(t) else t


def lower_blocks(texts: list[bytes | None]) -> Iterator[tuple[words.Block, np.ndarray]]:
    """Blocks of the lower-cased texts, each with the bytes before lower-casing."""
    held = [t or b"" for t in texts]
    for b in words.blocks([_lowered(t) for t in held], strip=True):
        own = held[b.lo : b.lo + b.n]
        yield b, np.frombuffer(own[0] if b.n == 1 else b"\n".join(own), dtype=np.uint8)


def _capitalised(b: words.Block, buf: np.ndarray) -> np.ndarray:
    """Words whose first letter, and not their second one, lower-casing has changed."""
    changed = np.append(0, np.cumsum(buf != b.buf))

    def capital(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lead = buf[np.minimum(at, len(buf) - 1)]
        end = np.minimum(at + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), b.ends)
        return changed[end] > changed[np.minimum(at, end)], end

    first, rest = capital(b.starts)
    return first & (rest < b.ends) & ~capital(rest)[0]


@dataclass
class Tokens:
    """A form of a block: ``first[i]:first[i + 1]`` are the tokens of document i."""

    h: np.ndarray  # canonical hash
    slot: np.ndarray
    value: np.ndarray  # hash of the words themselves
    word: np.ndarray  # index of the first word
    first: np.ndarray


def forms(b: words.Block, buf: np.ndarray) -> Iterator[Tokens]:
    """Both forms of a block; ``buf`` has the capitals."""
    n = len(b.h)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        yield from (Tokens(b.h, none.astype(bool), b.h, none, b.first) for _ in range(2))
        return
    opening = b.first[:-1][b.n_words > 0]
    digit = (buf[b.starts] >= ord("0")) & (buf[b.starts] <= ord("9"))
    number = digit | _among(b.h, _NUMBERS)
    after = np.zeros(n, dtype=bool)
    after[1:] = number[:-1]
    after[opening] = False
    unit = after & ~number & _among(b.h, _UNITS)
    capital = _capitalised(b, buf) & ~number & ~unit
    # A word begins a sentence if it is a document's first or follows . ! ? : or a line break.
    begins = np.zeros(n, dtype=bool)
    begins[opening] = True
    at = np.flatnonzero(capital & ~begins)  # only there does it matter
    for d in range(1, 4):  # the separators and punctuation just before the word
        c = buf[np.maximum(b.starts[at] - d, 0)]
        begins[at] |= (c == ord(".")) | (c == ord("!")) | (c == ord("?")) | (c == ord(":")) | (c == ord("\n"))
        at = at[words.IS_SPACE[c] | words.IS_PUNCTUATION[c]]
    opens = np.zeros(n, dtype=bool)
    opens[opening] = True
    for name in (capital & ~begins, capital):
        more = np.zeros(n, dtype=bool)  # words of a name behind its first
        more[1:] = name[1:] & name[:-1] & ~opens[1:]
        word = np.flatnonzero(~more)
        value = b.h
        if more.any():  # a name's words make one value, whatever lies before them
            which = np.cumsum(~more) - 1
            rank = np.arange(n) - word[which]
            parts = words.mix(b.h + rank.astype(np.uint64) * U(0x9E3779B97F4A7C15))
            total = np.append(U(0), np.cumsum(parts, dtype=np.uint64))
            end = np.append(word[1:], n)
            value = np.where(end - word > 1, total[end] - total[word], b.h[word])
        h = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, b.h)))[word]
        yield Tokens(h, (number | unit | name)[word], value, word, np.searchsorted(word, b.first))


def template_windows(t: Tokens, k: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first tokens of the windows of k tokens: of the canonical ones where enough of them
    are plain, else of the words themselves."""
    n = len(t.h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    plain = np.append(0, np.cumsum(~t.slot))
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    dense = np.flatnonzero(plain[at + k] - plain[at] < s.min_literal)
    x = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        x = x * U(0xA0761D6478BD642F) + t.h[j : j + n]
    x = x[at]
    if len(dense):
        own = np.full(len(dense), k + 0x100, dtype=np.uint64)
        for j in range(k):
            own = own * U(0xA0761D6478BD642F) + t.value[at[dense] + j]
        x[dense] = own
    return words.mix(x), at


@dataclass
class Form:
    """Windows of benchmark items in one form, ordered by hash."""

    window: np.ndarray  # hash
    item: np.ndarray  # row of the item
    at: np.ndarray  # position in the item
    sizes: list[int]  # window lengths that occur
    n_tokens: np.ndarray
    values: list[np.ndarray]  # of each item, what its tokens are
    slots: list[np.ndarray]
    seen: np.ndarray  # by the top 16 bits of a hash, whether a window has them

    @staticmethod
    def build(own: list[tuple[int, Tokens]], s: Settings) -> Form:
        parts, sizes, values, slots, n_tokens = [], set(), [], [], []
        for lo, t in own:
            n = np.diff(t.first)
            for i in range(len(n)):
                values.append(t.value[t.first[i] : t.first[i + 1]])
                slots.append(t.slot[t.first[i] : t.first[i + 1]])
            n_tokens.append(n)
            for k in {s.window, *(int(x) for x in n if s.min_literal <= x < s.window)}:
                w, at = template_windows(t, k, s)
                doc = np.searchsorted(t.first, at, side="right") - 1
                if k < s.window:  # only items that are one such window
                    some = n[doc] == k
                    w, at, doc = w[some], at[some], doc[some]
                if len(w):
                    sizes.add(k)
                parts.append((w, doc + lo, at - t.first[doc]))
        w, item, at = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
        order = np.argsort(w, kind="stable")
        seen = np.zeros(1 << 16, dtype=bool)
        seen[(w >> U(48)).astype(np.int64)] = True
        return Form(w[order], item[order], at[order], sorted(sizes), np.concatenate([np.empty(0, dtype=np.int64), *n_tokens]), values, slots, seen)


@dataclass
class Index:
    """Benchmark items in both forms."""

    ids: list
    forms: list[Form]

    @staticmethod
    def build(ids: list, texts: list[str | None], s: Settings) -> Index:
        both: list[list[tuple[int, Tokens]]] = [[], []]
        for b, buf in lower_blocks([(t or "").encode() for t in texts]):
            for held, t in zip(both, forms(b, buf), strict=True):
                held.append((b.lo, t))
        return Index(list(ids), [Form.build(x, s) for x in both])


FOUND = "first_word long, item_first_word long, n_words long, n_windows long, n_slots long, n_changed long, consistent double, contaminated boolean"


def occurrences(texts: list[bytes | None], x: Index, s: Settings) -> Iterator[tuple]:
    """(row, item_id, *FOUND) of every occurrence in a batch of texts."""
    if not any(len(f.window) for f in x.forms):
        return
    for b, buf in lower_blocks(texts):
        certain = set()  # document and item of contamination in the first form
        for form, t in zip(x.forms, forms(b, buf), strict=True):
            for d, item, found in _occurrences(t, form, s):
                if form is x.forms[0]:
                    certain |= {(d, item)} if found[-1] else set()
                elif (d, item) in certain or not found[-1]:
                    continue
                yield b.lo + d, x.ids[item], *found


def _occurrences(t: Tokens, x: Form, s: Settings) -> Iterator[tuple[int, int, tuple]]:
    found = []
    for k in x.sizes:
        w, at = template_windows(t, k, s)
        some = np.flatnonzero(x.seen[(w >> U(48)).astype(np.int64)])
        w, at = w[some], at[some]
        lo, hi = np.searchsorted(x.window, w), np.searchsorted(x.window, w, side="right")
        times = hi - lo
        hit = np.repeat(np.arange(len(w)), times)
        ref = np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
        if k < s.window:
            own = x.n_tokens[x.item[ref]] == k
            hit, ref = hit[own], ref[own]
        if len(hit):
            found.append(np.stack([x.item[ref], at[hit] - x.at[ref], at[hit], np.full(len(hit), k)], axis=1))
    if not found:
        return
    rows = np.concatenate(found)
    doc = np.searchsorted(t.first, rows[:, 2], side="right") - 1
    rows = np.column_stack([doc, rows])
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    cut = np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1)) + 1
    for own in np.split(rows, cut):
        d, item, shift = (int(v) for v in own[0, :3])
        yield d, item, _occurrence(own[:, 3], int(own[0, 4]), shift, d, item, t, x, s)


def _occurrence(at: np.ndarray, k: int, shift: int, doc: int, item: int, t: Tokens, x: Form, s: Settings) -> tuple:
    """Judges the matching windows, at these first tokens, of one item on one alignment."""
    covered = np.unique((at[:, None] + np.arange(k)).ravel())
    runs = np.split(covered, np.flatnonzero(np.diff(covered) > 1) + 1)
    longest = max(len(r) for r in runs)
    ref = covered - shift
    is_slot = x.slots[item][ref]
    theirs, ours = x.values[item][ref][is_slot], t.value[covered][is_slot]
    n_slots = int(is_slot.sum())
    agree = 0
    if n_slots:  # for each value of the item, the document's most frequent one opposite it
        pair, count = np.unique(np.stack([theirs, ours], axis=1), axis=0, return_counts=True)
        key, where = np.unique(pair[:, 0], return_inverse=True)
        best = np.zeros(len(key), dtype=np.int64)
        np.maximum.at(best, where.ravel(), count)
        agree = int(best.sum())
    consistent = agree / n_slots if n_slots else 1.0
    long_enough = longest >= s.min_words or len(covered) >= s.min_share * int(x.n_tokens[item])
    first = int(t.word[covered[0]]) - int(t.word[t.first[doc]])
    return first, int(ref[0]), len(covered), len(at), n_slots, int((theirs != ours).sum()), consistent, bool(long_enough and consistent >= s.min_consistent)


def _indexes(items: DataFrame, s: Settings) -> tuple[int, Iterator[Index]]:
    """The benchmark in blocks of bounded size, and how many."""
    n_words = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")).cast("long")
    total = items.agg(F.sum(n_words).alias("n")).collect()[0].n or 0
    n_blocks = max(1, -(-2 * total // s.max_index_words)) if total > s.max_index_words else 1

    def blocks() -> Iterator[Index]:
        for i in range(n_blocks):
            own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == i) if n_blocks > 1 else items
            rows = own.select("item_id", "text").orderBy("item_id", "text").collect()
            yield Index.build([r.item_id for r in rows], [r.text for r in rows], s)

    return n_blocks, blocks()


def _with_hits(docs: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """The documents with ``_hit``: whether a window of theirs may be one of the benchmark's."""
    spark = docs.sparkSession
    bits = np.zeros(1 << (s.filter_bits - 3), dtype=np.uint8)
    sizes: list[set[int]] = [set(), set()]
    for x in _indexes(items, s)[1]:
        for held, form in zip(sizes, x.forms, strict=True):
            held |= set(form.sizes)
            at = form.window >> U(64 - s.filter_bits)
            np.bitwise_or.at(bits, (at >> U(3)).astype(np.int64), (1 << (at & U(7)).astype(np.uint8)).astype(np.uint8))
    known = spark.sparkContext.broadcast(bits)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hit = np.zeros(batch.num_rows, dtype=bool)
            for b, buf in lower_blocks(words.column_bytes(batch, "text")):
                for own, t in zip(sizes, forms(b, buf), strict=True):
                    for k in own:
                        w, at = template_windows(t, k, s)
                        place = w >> U(64 - s.filter_bits)
                        some = known.value[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8) & 1
                        hit[b.lo + np.searchsorted(t.first, at[some.astype(bool)], side="right") - 1] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[*batch.schema.names, "_hit"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_hit", BooleanType())]))


def find(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``item_id`` and ``FOUND`` of every occurrence of a benchmark item's windows."""
    spark = docs.sparkSession
    words.small_batches(spark)
    fields = [StructField("doc_id", LongType()), StructField("item_id", items.schema["item_id"].dataType), *StructType.fromDDL(FOUND).fields]
    schema = StructType(fields)
    n_blocks, indexes = _indexes(items, s)
    own = docs.select("doc_id", "text")
    if n_blocks > 1:
        own = written(_with_hits(own, items, s).where("_hit").drop("_hit"), "documents-with-hits")
    out = None
    for x in indexes:
        index = spark.sparkContext.broadcast(x)

        def run(batches, index=index):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(schema)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[i], *rest) for i, *rest in occurrences(words.column_bytes(batch, "text"), index.value, s)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=arrow.names)

        one = own.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents that hold no contamination, with all their columns."""
    spark = docs.sparkSession
    words.small_batches(spark)
    n_blocks, indexes = _indexes(items, s)
    others = None
    if n_blocks > 1:
        marked = _with_hits(docs, items, s)
        others = marked.where("NOT _hit").drop("_hit")
        docs = written(marked.where("_hit").drop("_hit"), "documents-with-hits")
    for x in indexes:
        index = spark.sparkContext.broadcast(x)

        def run(batches, index=index):
            import pyarrow as pa

            for batch in batches:
                bad = {row[0] for row in occurrences(words.column_bytes(batch, "text"), index.value, s) if row[-1]}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs if others is None else docs.unionByName(others)


def query(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The contaminated documents: every contaminating occurrence."""
    return find(docs, items, s).where("contaminated")
