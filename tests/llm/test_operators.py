import functools
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratalog.llm import chat_collapse, conflict_packing, contiguous_shards, decision_list, decontaminate, partenum_join, quality_ftrl, repair_tokens, toxicity_rnn, warc_derivatives, words
from stratalog.llm.components import components

from . import awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def docs(spark):
    return awkward.documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def key(r):
    return tuple((x is None, x) for x in r)


# -- words


def test_words_equal_the_pattern(rows):
    seen = {}
    for b in words.blocks([(t or "").encode() for _, t in rows], target=3000):
        for i in range(b.n):
            text = fold(rows[b.lo + i][1] or "")
            want = WORD.findall(text)
            got = b.h[b.first[i] : b.first[i + 1]].tolist()
            assert len(want) == len(got)
            for w, h in zip(want, got, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_words_and_texts_are_cut_between_words(monkeypatch):
    data = ("a" * 900 + " " + "bc " * 2000 + "d" * 5000).encode()
    whole = words.word_hashes(data)
    monkeypatch.setattr(words, "PIECE", 256)
    for x, y in zip(whole, words.word_hashes(data), strict=True):
        assert (x == y).all()


# -- 1: token blocks


def test_token_files_round_trip(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = repair_tokens.query(docs, repair_tokens.Settings(block_tokens=3000)).collect()
    want = Counter()
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[(d, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    assert repair_tokens.query(awkward.empty(spark, docs)).count() == 0


def test_pieces_have_the_ids_of_the_whole_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["<|ENDOFTEXT|>", "a <|EndOfText|> b", "<|StartOfText|>é", "x<|endoftext|>Y", "TAKSİ.", "taksİ, TAKSİ! İ.", "\u0915\u093c. \u0958.", "\u212a. \u212b.", "Straße. ÉCOLE, ﬁ;"]
    got = repair_tokens.Encoder(path, 12).encode([x.encode() for x in texts])
    for x, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_any_text_has_the_ids_of_the_whole_text():
    import unicodedata

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    e = repair_tokens.Encoder(path, 10)
    every = [chr(c) for c in range(0x20, 0x3000) if chr(c).isprintable()] + list("\t\n\x0b\x0c\r\x1c\x85\xa0\u200b\u3000\ufeff\u200d\u0300\u0307\U0001f600")
    marked = [chr(c) for c in range(0x3000) if chr(c).isalpha() and not unicodedata.normalize("NFC", chr(c)).lower().isalpha()]
    assert "\u0130" in marked and "\u0958" in marked
    texts = [m + x for m in marked for x in [*e.TAIL, " .", ". x"]]
    rng = random.Random(11)
    for _ in range(20_000):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts += ["".join(rng.choice(rng.choice([every, "abcdeABC", marked])) for _ in range(rng.randint(1, 4))), rng.choice(["", " ", "'s", "0", "\n", *e.TAIL])]
        texts.append("".join(parts))
    for lo in range(0, len(texts), 500):
        some = texts[lo : lo + 500]
        for x, ids in zip(some, e.encode([x.encode() for x in some]), strict=True):
            assert np.frombuffer(ids, dtype="<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_a_document_with_more_pieces_than_the_table_holds():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    e = repair_tokens.Encoder(path, 8)
    for text in (" ".join(f"w{i}" for i in range(10_000)), "a b c", " ".join(f"x{i}" for i in range(250)), "w1 w2 x3"):
        assert np.frombuffer(e.encode([text.encode()])[0], dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    cased = public_tokenizers.path("byte_bpe_50k.json")
    assert not repair_tokens.Encoder(cased, 8).splits
    t = Tokenizer.from_file(cased)
    assert np.frombuffer(repair_tokens.Encoder(cased, 8).encode([b"Hello World and NASA"])[0], dtype="<u4").tolist() == t.encode("Hello World and NASA", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_re_pair_expands_to_what_it_compressed(seed):
    rng = np.random.default_rng(seed)
    docs = [np.append(rng.integers(0, rng.integers(2, 60) if seed else 2, rng.integers(0, 600)), 1).astype("<u4") for _ in range(12)]
    if seed == 3:
        docs.append(np.append(np.zeros(4000), 1).astype("<u4"))
    if seed == 4:
        docs = [d + (np.arange(len(d)) % 3 == 0).astype("<u4") * 70000 for d in docs]
    block = repair_tokens.pack(list(range(len(docs))), [d.tobytes() for d in docs], repair_tokens.Settings(min_count=2, max_rounds=9))
    r = repair_tokens.Reader(block)
    assert (r.decode() == np.concatenate(docs)).all() and len(r.rules) > 0
    for i, d in enumerate(docs):
        a = int(rng.integers(0, len(d) + 1))
        z = int(rng.integers(a, len(d) + 1))
        assert (r.decode_range(i, a, z) == d[a:z]).all()


def test_re_pair_goes_on_until_no_pair_is_frequent():
    passage = np.random.default_rng(7).integers(0, 500, 256)
    docs = [np.append(passage, 1).astype("<u4") for _ in range(200)]
    s = repair_tokens.Settings()
    last = np.cumsum([len(d) for d in docs]) - 1
    marks = np.zeros(last[-1] + 1, dtype=bool)
    marks[last] = True
    seq, ends, rules, base = repair_tokens.compress(np.concatenate(docs), marks, s)
    pairs = Counter((a, b) for a, b, e in zip(seq[:-1].tolist(), seq[1:].tolist(), ends[:-1].tolist(), strict=True) if not e)
    assert max(pairs.values(), default=0) < s.min_count
    assert len(seq) <= 2 * len(docs) and int(repair_tokens.expansion_lengths(rules, base).max()) > 16


# -- 2: decontamination


def test_reparameterised_questions_are_found(spark, docs):
    items = spark.createDataFrame([(1, "Maria Lopez bought 12 apples for 3 dollars each. How much did Maria pay for the 12 apples in total?"), (2, awkward.prose(3, 60)), (3, None), (4, ""), (5, "two words"), (2, awkward.prose(3, 60))], "item_id long, text string")
    more = [
        (100, "Today Peter Smith bought 7 apples for 4 euros each. How much did Peter pay for the 7 apples in total? Well."),
        (101, "Today Peter Smith bought seven apples for 4 euros each. How much did Peter pay for the seven apples in total?"),
        (102, "A text about apples that nobody bought and dollars that nobody paid in total."),
    ]
    both = docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(i, t, None) for i, t in more], "doc_id long, text string, score string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.query(both, items).collect()}
    assert got == {(100, 1), (101, 1), (4, 2)}
    r = decontaminate.query(both, items).where("doc_id = 100").collect()[0]
    assert r.n_slots == 6 and r.n_changed == 6 and r.consistent == 1.0
    kept = [x.doc_id for x in decontaminate.clean(both, items).collect()]
    assert sorted(kept, key=str) == sorted((r.doc_id for r in both.collect() if r.doc_id not in (4, 100, 101)), key=str)
    assert decontaminate.query(awkward.empty(spark, docs), items).count() == 0
    assert decontaminate.query(docs, awkward.empty(spark, items)).count() == 0


def test_slots_must_be_consistent():
    item = "Anna gave 5 coins to Bernd and Anna kept 5 coins while Bernd lost the coins of Anna today in the park"
    x = decontaminate.Index.build([1], [item], decontaminate.Settings())
    same = item.replace("Anna", "Carla").replace("Bernd", "Dora").replace(" 5 ", " 9 ")
    mixed = "Carla gave 1 coins to Dora and Emil kept 2 coins while Fritz lost the coins of Gerda today in the park"
    judged = {t: [r[-1] for r in decontaminate.occurrences([("So " + t).encode()], x, decontaminate.Settings())] for t in (same, mixed)}
    assert judged == {same: [True], mixed: [False]}


def test_verbatim_copies_of_items_dense_in_slots_are_found():
    listed = "Weights: " + ", ".join(f"{n} {i + 11} kg" for i, n in enumerate("Anna Bernd Carla Dora Emil Fritz Gerda Hans Ida Jonas Karl Lena Max".split()))
    items = ["Compute 12 + 7 + 9", listed, "Add 3 4 5 6 7 8 9 10 and then 11"]
    x = decontaminate.Index.build([1, 2, 3], items, decontaminate.Settings())
    other = listed.replace("1", "2").replace("3", "4")
    texts = ["Please compute 12 + 7 + 9 now.", f"So it was said. {listed}; and so on.", "we add 3 4 5 6 7 8 9 10 and then 11 of them", "Compute 13 + 8 + 9", other]
    got = [(r[0], r[1], r[-1]) for r in decontaminate.occurrences([t.encode() for t in texts], x, decontaminate.Settings())]
    assert got == [(0, 1, True), (1, 2, True), (2, 3, True)]


RED = "Anna has 5 red apples at home. Anna buys 3 more at the shop. Anna eats 2 of them. How many apples does Anna have now?"


@pytest.mark.parametrize(
    "item, text",
    [
        (RED, RED.replace("Anna", "Peter").replace("5", "9").replace("3", "4")),
        (RED, RED.replace("Anna", "Maria Lopez").replace("2", "7")),
        (RED.replace("Anna", "Maria Lopez"), RED.replace("Anna", "Jo")),
        ("вчера Анна купила 12 яблок и отдала Ивану 3 яблока а потом Анна съела одно яблоко дома", "вчера Ольга купила 7 яблок и отдала Петру 2 яблока а потом Ольга съела одно яблоко дома"),
        ("yesterday Élodie sold 12 old books to Øystein and kept 3 new books for her own shelf", "yesterday Zoë sold 5 old books to Łukasz and kept 4 new books for her own shelf"),
        ("in İzmir Anna paid 12 coins for the old boat that Bernd had built in the long winter", "in İzmir Carla paid 7 coins for the old boat that Dora had built in the long winter"),
    ],
)
def test_other_names_and_numbers_are_found(item, text):
    s = decontaminate.Settings()
    x = decontaminate.Index.build(["a"], [item], s)
    around = "Some words before it. " + text + " And some more words after it."
    assert any(r[-1] for r in decontaminate.occurrences([around.encode()], x, s))
    other = "A shop sells red apples and many more people eat them at home now than before the long winter came"
    assert not any(r[-1] for r in decontaminate.occurrences([other.encode()], x, s))


def naive_forms(text):
    """Tokens (canonical, is slot, value) of both forms, character by character."""
    found = []
    for m in WORD.finditer(text):
        w = m.group()
        lo, hi = m.start(), m.end()
        while lo < hi and text[lo] < "\x7f" and not text[lo].isalnum() and text[lo] > " ":
            lo += 1
        while hi > lo and text[hi - 1] < "\x7f" and not text[hi - 1].isalnum() and text[hi - 1] > " ":
            hi -= 1
        if lo < hi:
            found.append((lo, text[lo:hi]))
    numbers, units = set(decontaminate.NUMBERS.split()), set(decontaminate.UNITS.split())
    out = []
    for second in (False, True):
        tokens, was_number, was_name = [], False, False
        for i, (at, w) in enumerate(found):
            low = w.lower()
            number = w[0] in "0123456789" or low in numbers
            unit = was_number and not number and low in units
            capital = not number and not unit and w[0] != w[0].lower() and len(w) > 1 and w[1] == w[1].lower()
            gap = text[at - 1 :: -1] if at else ""
            opens = i == 0
            for c in gap[:3]:
                if c in ".!?:\n":
                    opens = True
                if not (c in " \t\n\x0b\x0c\r" or (c < "\x7f" and not c.isalnum())):
                    break
            name = capital and (second or not opens)
            if name and was_name:
                tokens[-1] = ("<name>", True, (*tokens[-1][2], low))
            else:
                tokens.append(("<number>" if number else "<unit>" if unit else "<name>" if name else low, number or unit or name, (low,)))
            was_number, was_name = number, name
        out.append(tokens)
    return out


def naive_contaminated(text, item, s):
    for doc, ref in zip(naive_forms(text), naive_forms(item), strict=True):
        k = s.window if len(ref) >= s.window else len(ref)
        if k < s.min_literal:
            continue

        def key(tokens, i):
            own = tokens[i : i + k]
            plain = sum(not t[1] for t in own) >= s.min_literal
            return (plain, *(t[0] if plain else t[2] for t in own))

        shifts = {}
        for i in range(len(doc) - k + 1):
            for j in range(len(ref) - k + 1):
                if key(doc, i) == key(ref, j):
                    shifts.setdefault(i - j, set()).update(range(i, i + k))
        for shift, covered in shifts.items():
            run = longest = 0
            for i in range(len(doc)):
                run = run + 1 if i in covered else 0
                longest = max(longest, run)
            pairs = Counter((ref[i - shift][2], doc[i][2]) for i in covered if ref[i - shift][1])
            best = {}
            for (a, _), n in pairs.items():
                best[a] = max(n, best.get(a, 0))
            share = sum(best.values()) / sum(pairs.values()) if pairs else 1.0
            if (longest >= s.min_words or len(covered) >= s.min_share * len(ref)) and share >= s.min_consistent:
                return True
    return False


def test_contamination_equals_brute_force(spark):
    rng = random.Random(5)
    names = "Anna Bernd Carla Dora Maria-Lopez Ольга Éva NASA".split()

    def sentence():
        out = [rng.choice([*names, "The", "How", "so"])]
        for _ in range(rng.randrange(4, 10)):
            out.append(rng.choice([rng.choice(names), str(rng.randrange(30)), "kg", "seven", "dollars", *"buys sells old red boats the of many at home now".split()]))
        return " ".join(out) + rng.choice([".", "?", "!", ":", ""])

    items = [(str(i), " ".join(sentence() for _ in range(rng.randrange(1, 4)))) for i in range(40)] + [("none", None), ("empty", "")]
    docs = []
    for i in range(160):
        _, item = items[rng.randrange(40)]
        w = item.split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            j = rng.randrange(len(w))
            w[j] = rng.choice([*names, "Jo Smith", str(rng.randrange(30)), "other", w[j].lower()])
        docs.append((i, " ".join([sentence() if rng.random() < 0.7 else "", " ".join(w), sentence()])))
    s = decontaminate.Settings(window=5, min_literal=2, min_words=8)
    want = {(d, i) for d, t in docs for i, item in items if naive_contaminated(t, item or "", s)}
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for blocks in (1_000_000, 200):
        x = decontaminate.Settings(window=5, min_literal=2, min_words=8, max_index_words=blocks, filter_bits=12)
        assert {(r.doc_id, r.item_id) for r in decontaminate.query(a, b, x).collect()} == want
        assert {r.doc_id for r in decontaminate.clean(a, b, x).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert 60 < len({d for d, _ in want}) < 160


def test_benchmark_blocks_give_the_same(spark, docs):
    items = spark.createDataFrame([(i, awkward.prose(3, 400)[i * 40 : i * 40 + 300]) for i in range(20)], "item_id long, text string")
    a = decontaminate.query(docs, items).collect()
    b = decontaminate.query(docs, items, decontaminate.Settings(max_index_words=300)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and a


# -- 3: chat collapse


def test_prefix_conversations_collapse(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", None), (4, 0, "user", "hi"), (4, 1, "assistant", "hello"), (4, 2, "user", None), (5, 0, None, "hi"), (6, 0, "user", ""), (None, 0, "user", "lost"), (7, 0, "user", "hi"), (7, 1, "assistant", "hello"), (7, 2, "user", "")]
    t = spark.createDataFrame([(*r, "x", "y") for r in turns], "conv_id long, turn long, role string, text string, value string, n string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat_collapse.query(t).collect()}
    assert set(got) == {3, 5, 6, 7} and got[3][:2] == (3, 2) and got[7][:2] == (3, 1)
    assert got[3][2] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nhello\n<|end|>\n<|user|>\n\n<|end|>\n" and got[5][2].startswith("<|unknown|>")
    assert chat_collapse.query(awkward.empty(spark, t)).count() == 0


# -- 4: Jaccard join


def shingles(text, k=4):
    w = WORD.findall(fold(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, k=4, percent=85):
    sets = [shingles(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_join_equals_brute_force(spark, docs, rows):
    got = [tuple(r) for r in partenum_join.query(docs).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)
    assert partenum_join.query(awkward.empty(spark, docs)).count() == 0


@pytest.mark.parametrize("hubs", [1, 64])
def test_join_of_near_copies_in_chains_and_at_the_threshold(spark, hubs):
    rng = random.Random(hubs)
    rows, n = [], 0
    for g in range(12):
        words_ = awkward.prose(100 + g, rng.choice([5, 8, 14, 40, 90])).split()
        for _ in range(14):
            rows.append((n, " ".join(words_)))
            n += 1
            for _ in range(rng.choice([0, 1, 1, 2])):  # a chain: each copy changes the one before
                words_[rng.randrange(len(words_))] = f"w{rng.randrange(10**6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in partenum_join.query(df, partenum_join.Settings(hubs=hubs)).collect()]
    assert sorted(got) == sorted(brute_components(rows))
    assert 12 < len({r[2] for r in got}) < len(rows)


@pytest.mark.parametrize("block", [3, 256])
def test_all_links_within_components_are_found(spark, block):
    rng = random.Random(block)
    rows = [(1000, ""), (1001, None), (1002, "alone here")]
    for g in range(5):
        base = awkward.prose(200 + g, 160).split()
        for i in range(9):
            own = list(base)
            for _ in range(i % 4):
                own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
            rows += [(len(rows), " ".join(own))] * (2 if i == 5 else 1)
    sets = [shingles(t, 4) for _, t in rows]

    def links(x, y):
        both = len(x & y)
        return bool(x and y) and 100 * both >= 85 * (len(x) + len(y) - both)

    df = spark.createDataFrame(rows, "doc_id long, text string")
    s = partenum_join.Settings(block=block)
    want = [(d, len(x), sum(links(x, y) for j, y in enumerate(sets) if j != i)) for i, ((d, _), x) in enumerate(zip(rows, sets, strict=True))]
    got = partenum_join.linked(df, s).collect()
    assert sorted((r.doc_id, r.n_shingles, r.n_links) for r in got) == sorted(want)
    pairs, members = partenum_join.join(df, s)
    of = {r.doc_id: r["class"] for r in members.collect()}
    found = {(r.a, r.b, r.n_a + r.n_b, r.n_both) for r in pairs.collect()}
    assert pairs.count() == len(found)
    expected = set()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            a, b = of[rows[i][0]], of[rows[j][0]]
            if links(x, y) and a < b:
                expected.add((a, b, len(x) + len(y), len(x & y)))
    assert found == expected and len(found) > 40
    assert all(r[2] == 0 for r in want[:3]) and of[1000] is None


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(0)
    linked = 0
    for _ in range(600):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64) << np.uint64(1))
        k = int(rng.integers(0, len(a) // 6 + 2))
        gone = int(rng.integers(0, k + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, k - gone).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            linked += 1
            x, y = partenum_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert len(np.intersect1d(x, y))
    assert linked > 200


def test_a_task_holds_few_copies_of_its_signatures(monkeypatch):
    """What is handed on is every signature in its bucket; at no time are there five arrays of them."""
    released = []
    monkeypatch.setattr(words, "release", lambda: released.append(1), raising=False)
    monkeypatch.setattr(words, "blocks", functools.partial(words.blocks, target=1 << 16))
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, row)) for row in rng.integers(0, 10**6, (6000, 200)).tolist()]
    s, short = partenum_join.Settings(flush=1 << 19), partenum_join.Short(32, 50)
    batches = [pa.record_batch({"text": texts[lo : lo + 1000]}) for lo in range(0, len(texts), 1000)]
    want = {}
    for b in words.blocks([t.encode() for t in texts]):
        h, cut = partenum_join.shingle_sets(b, s.words)
        sig, owner = partenum_join.owned_signatures(h, cut, s)
        number = (sig << np.uint64(32)) | short.ids(partenum_join._digests(h, cut, 0))[owner]
        for k, x in zip(((sig >> np.uint64(32)) * np.uint64(50) >> np.uint64(32)).tolist(), number.tolist(), strict=True):
            n, total = want.get(k, (0, 0))
            want[k] = n + 1, (total + x) % (1 << 64)
    assert sum(n for n, _ in want.values()) > s.flush

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    got = {}
    tracemalloc.start()
    for out in partenum_join._buckets(Docs(), s, 0, short)(iter(batches)):
        assert out.nbytes < 1 << 23
        for k, data in zip(out.column(0).to_pylist(), out.column(1), strict=True):
            x = np.frombuffer(data.as_buffer(), dtype="<u8")
            n, total = got.get(k, (0, 0))
            got[k] = n + len(x), (total + int(x.sum(dtype=np.uint64))) % (1 << 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and released
    assert peak < 5 * 8 * s.flush


def test_sketches_of_many_pairs_are_compared_in_little_memory():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64)) for _ in range(200)]
    sets += [np.unique(np.concatenate([x[: 1000 - 5 * i], rng.integers(0, 1 << 63, 5 * i, dtype=np.uint64)])) for i, x in enumerate(sets[:40])]
    cut = np.append(0, np.cumsum([len(x) for x in sets]))
    data = partenum_join.sketches(np.concatenate(sets), cut)
    a, b = np.triu_indices(len(sets), 1)
    a, b = np.tile(a, 4), np.tile(b, 4)
    sketch = partenum_join._Sketches(np.diff(cut), data, 80)
    tracemalloc.start()
    got = sketch.may_link(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = [int.from_bytes(x, "little") for x in data]
    want = [(whole[i] ^ whole[j]).bit_count() * 180 <= 20 * (len(sets[i]) + len(sets[j])) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert got.tolist() == want and 0 < sum(want) < len(want)
    assert peak < 1 << 25


def test_deduplicate_keeps_one_of_each_group(spark, docs, rows):
    kept = partenum_join.deduplicate(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    want = brute_components(rows, 5, 80)
    groups = {r[2] if r[2] is not None else ("none", i) for i, r in enumerate(want) if r[1]}
    assert sum(1 for r in got if shingles(r.text, 5)) == len(groups)
    assert sum(1 for r in got if not shingles(r.text, 5)) == sum(1 for r in want if not r[1])


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {300: 300, 301: 300}


# -- 5: decision list


def brute_statistics(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("pos_bits", [20, 3])
def test_statistics_equal_brute_force(spark, docs, rows, monkeypatch, pos_bits):
    monkeypatch.setattr(decision_list, "POS_BITS", pos_bits)  # 3: the path of texts that are too long
    got = decision_list.query(docs, awkward.labels(spark)).collect()
    want = Counter()
    for d, t in rows:
        s = brute_statistics(t)
        want[(d, *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_rules_are_learned_and_kept_rows_keep_their_columns(spark, docs):
    rng = random.Random(0)
    data = [{**dict.fromkeys(decision_list.FEATURES, 0.0), "n_words": rng.random(), "symbols_per_word": s, "repeat_share": r, "bad": int(s > 0.5 or r > 0.7), "part": i % 3} for i in range(600) for s, r in [(rng.random(), rng.random())]]
    rules = decision_list.learn(data)
    wrong = sum(any(all(c.holds(d) for c in rule) for rule in rules) != d["bad"] for d in data)
    assert rules and wrong < 30
    assert decision_list.learn([]) == [] and decision_list.learn([d for d in data if not d["bad"]]) == []
    kept = decision_list.keep(docs, decision_list.train(docs, awkward.labels(spark)))
    judged = decision_list.query(docs, awkward.labels(spark))
    assert kept.columns == docs.columns and kept.count() == judged.where("kept").count() > 0
    assert decision_list.query(awkward.empty(spark, docs), awkward.empty(spark, awkward.labels(spark))).count() == 0


# -- 6: shards


def brute_capacity(sizes, n):
    best = [0] + [10**18] * len(sizes)
    for _ in range(n):
        best = [min([best[j], *(max(best[i], sum(sizes[i:j])) for i in range(j))]) for j in range(len(sizes) + 1)]
    return best[-1]


def test_smallest_capacity_equals_brute_force():
    rng = random.Random(0)
    for _ in range(150):
        sizes = [rng.choice([1, 2, 3, 5, rng.randint(1, 90)]) for _ in range(rng.randint(1, 22))]
        ends = np.cumsum(sizes).tolist()
        n = rng.randint(1, 6)
        c = contiguous_shards.smallest(ends, n)
        assert c == brute_capacity(sizes, n)
        at = [0, *(ends[k] for k in contiguous_shards.place(ends, n, c)), ends[-1]]
        assert len(at) - 1 <= n + 1 and max(b - a for a, b in zip(at, at[1:])) <= c


@pytest.mark.parametrize("first_bits", [2, 12])
def test_shards_are_contiguous_minimal_and_gapless(spark, docs, rows, monkeypatch, first_bits):
    monkeypatch.setattr(contiguous_shards, "FIRST_BITS", first_bits)  # few ranges: several refinements
    n = 5
    got = contiguous_shards.query(docs.unionByName(docs), n).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows for _ in range(2))
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.text_crc32, r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
    for s in range(n):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    order = contiguous_shards.digests(docs.unionByName(docs)).groupBy("k1", "k2").agg({"size": "sum"}).orderBy("k1", "k2").collect()
    largest = max(Counter({s: sum(r["size"] for r in got if r.shard == s) for s in range(n)}).values())
    assert largest == brute_capacity([r[2] for r in order], n)
    assert contiguous_shards.query(awkward.empty(spark, docs)).count() == 0


# -- 7: WARC


def test_records_round_trip(spark):
    pages = [(1, "http://a.example/x", "<html lang=en><head><title>T &amp; t</title><style>p{}</style></head><body><!-- no --><p>Hello <b>wor</b>ld<script>var t='</p>';</script></p><div>two<br>three</div><a href='/y'>link</a></body></html>"), (2, None, None), (3, "u", ""), (3, "u", ""), (4, "http://b\r\nx", "text <unclosed 'quote > more"), (None, "v", "<!-- open"), (5, "w", "a < b &lt;c&gt; é日" + "x" * 100000)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, block string")
    got = warc_derivatives.derive_pages(df).collect()
    assert len(got) == 2 * len(pages)
    for r in got:
        (rec,) = warc_derivatives.parse(bytes(r.record))
        assert rec.kind == r.warc_type and rec.record_id == r.record_id and rec.block.decode() == r.block and len(rec.block) == r.content_length
        assert warc_derivatives.digest(rec.block) == r.block_digest == rec.headers["WARC-Block-Digest"] and rec.headers["WARC-Refers-To"] == r.refers_to
        assert zlib.crc32(bytes(r.record)) == r.record_crc32
    text = {r.page_id: r.block for r in got if r.warc_type == "conversion"}
    assert text[1] == "T & t\nHello world\ntwo\nthree\nlink" and text[2] == "" and text[None] == "" and text[5].startswith("a < b <c> é日")
    meta = next(r for r in got if r.page_id == 1 and r.warc_type == "metadata")
    source = warc_derivatives.response(*pages[0])
    assert meta.refers_to == source.record_id and f"source-payload-digest: {source.headers['WARC-Payload-Digest']}" in meta.block and "language: en" in meta.block
    assert next(r.record_id for r in got if r.page_id == 1 and r.warc_type == "conversion") in meta.block
    assert warc_derivatives.query(awkward.empty(spark, df)).count() == 0


def naive_text(markup):
    """Visible text by one backtracking pattern."""
    hidden = r"<(script|style|template|noscript)(?![a-zA-Z0-9])[^>]*>.*?(?:</\1\s*>|\Z)"
    unfinished = r"<(?:script|style|template|noscript)(?![a-zA-Z0-9])[^>]*\Z"
    tag = r"<(/?[a-zA-Z][a-zA-Z0-9]*)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    other = r"<(/?[a-zA-Z][a-zA-Z0-9]*|[/!?])[^>]*(?:>|\Z)"

    def instead(m):
        if m[0].startswith("<!--"):
            return ""
        name = (m[2] or m[3] or "").lower()
        return "\n" if name.removeprefix("/") in warc_derivatives._BREAKS and not name.startswith("//") else " " if m[1] or re.match(unfinished, m[0], re.I | re.S) else ""

    import html

    text = re.sub(f"<!--.*?(?:-->|\\Z)|{hidden}|{unfinished}|{tag}|{other}", instead, markup.replace("\n", " "), flags=re.S | re.I)
    return re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f\v ]+", " ", html.unescape(text))).strip(" \n")


def test_page_text_equals_brute_force():
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<a href='x'>", "<a href=\"y>z\">", "<br/>", "<script>", "</script>", "</SCRIPT >", "<style a>", "</style>", "<!--", "-->", "<", ">", "'", '"', " ", "\n", "&amp;", "a < b", "word", "é", "<title>", "</title>", "<!DOCTYPE html>", "<html lang=de>", "</", "<?x", "<h1 class='", "<div data=\""]
    for _ in range(6000):
        markup = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert warc_derivatives.plain_text(markup) == naive_text(markup), markup


def test_open_markup_is_read_in_linear_time():
    import time

    for unit in ("<a ", '<a " ', "<a '>'", "<title>", "<html", "<script>", "<!-- ", "<a href ", "<a '>'<a \">\"", "&", "</", "<a 'x\"'>\"<b"):
        began = time.perf_counter()
        warc_derivatives.read_page(unit * (1_000_000 // len(unit)))
        assert time.perf_counter() - began < 5, unit
    page = warc_derivatives.read_page("<HTML dir=ltr LANG='de-AT'><title>One &amp; <b>two</b></title><title>no</title><a name=x>1</a><a href=y>2</a><a\nhref = z>3")
    assert (page.title, page.language, page.links, page.text) == ("One & two", "de-AT", 2, "One & two\nno\n123")


def test_broken_files_are_reported(spark, tmp_path):
    import gzip

    good = [warc_derivatives.response(i, f"http://x/{i}", f"<p>page {i}</p>").serialize() for i in range(4)]
    lower = good[1].replace(b"Content-Length: ", b"content-length:", 1).replace(b"WARC-Type: ", b"warc-type:  ")
    no_length = good[2].replace(b"Content-Length:", b"Length:", 1)
    no_colon = good[3].replace(b"\r\nWARC-Date", b"\r\nno colon here\r\nX-Long: a\r\n b\r\nWARC-Date", 1)
    data = good[0] + lower + no_length + no_colon + good[0][:-30]
    found = list(warc_derivatives.records(data))
    assert [type(r).__name__ for r in found] == ["Record", "Record", "Broken", "Record", "Broken"]
    assert [r.reason for r in found if isinstance(r, warc_derivatives.Broken)] == ["no content length", "cut off"]
    assert found[1].block == next(warc_derivatives.parse(good[1])).block and found[3].headers["X-Long"] == "a b"
    assert [type(r).__name__ for r in warc_derivatives.records(b"rubbish\r\n\r\n" + good[0])] == ["Broken", "Record"]
    assert list(warc_derivatives.records(b"")) == [] and len(list(warc_derivatives.records(b"WARC/1.0"))) == 1
    with pytest.raises(ValueError):
        list(warc_derivatives.parse(data))
    (tmp_path / "a.warc").write_bytes(data)
    packed = gzip.compress(b"".join(good))
    (tmp_path / "b.warc.gz").write_bytes(packed + packed[:40])
    got = warc_derivatives.derive_files(spark, f"file://{tmp_path}").collect()
    assert sorted(r.block for r in got if r.warc_type == "conversion") == sorted(f"page {i}" for i in (0, 1, 3, 0, 1, 2, 3))
    assert sorted(r.block for r in got if r.warc_type == "broken") == ["cut off", "no content length"]
    (tmp_path / "b.warc.gz").unlink()
    got = warc_derivatives.derive_files(spark, f"file://{tmp_path}", by_record=True).collect()
    assert sorted(r.block for r in got if r.warc_type == "conversion") == [f"page {i}" for i in (0, 1, 3)]
    assert sorted(r.block for r in got if r.warc_type == "broken") == ["cut off", "no content length"]


def test_files_give_the_same_records(spark, tmp_path):
    import gzip

    data = b"".join(warc_derivatives.response(i, f"http://x/{i}", f"<p>page {i}</p>").serialize() for i in range(5))
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data[:0]) + gzip.compress(data))
    got = warc_derivatives.derive_files(spark, f"file://{tmp_path}").collect()
    assert len(got) == 20 and {r.block for r in got if r.warc_type == "conversion"} == {f"page {i}" for i in range(5)}


# -- 8 and 9: classifiers


def test_gradients_are_those_of_the_loss(monkeypatch):
    monkeypatch.setattr(toxicity_rnn, "f32", np.float64)
    s = toxicity_rnn.Settings(word_bits=6, char_bits=6, dim=3, hidden=2, window=5, stride=3)
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity_rnn.initial(s).items()} | {"a": rng.normal(size=4), "bias": rng.normal(size=1)}
    x, length, d = rng.normal(size=(5, 3, 3)), np.array([5, 3, 0]), rng.normal(size=3)
    _, kept = toxicity_rnn.forward(x, length, p, s, True)
    g, d_x = toxicity_rnn.backward(d, kept, p, s)

    def loss(q, y):
        return toxicity_rnn.forward(y, length, q, s) @ d

    for name in g:
        for i in range(min(5, p[name].size)):
            hi, lo = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            hi[name].flat[i] += 1e-5
            lo[name].flat[i] -= 1e-5
            assert abs((loss(hi, x) - loss(lo, x)) / 2e-5 - g[name].flat[i]) < 1e-6
    for i in range(x.size):
        hi, lo = x.copy(), x.copy()
        hi.flat[i] += 1e-5
        lo.flat[i] -= 1e-5
        assert abs((loss(p, hi) - loss(p, lo)) / 2e-5 - d_x.flat[i]) < 1e-6


def test_windows_cover_every_text():
    s = toxicity_rnn.Settings(window=10, stride=6)
    n = np.array([0, 1, 10, 11, 16, 17, 100])
    first = np.append(0, np.cumsum(n))
    doc, start, length = toxicity_rnn._all_spans(n, first, s)
    for i, k in enumerate(n):
        own = sorted((int(a - first[i]), int(a - first[i] + z)) for d, a, z in zip(doc, start, length, strict=True) if d == i)
        assert own == sorted(toxicity_rnn.spans(int(k), s))
        assert set().union(*(range(a, z) for a, z in own)) == set(range(k))


def naive_toxicity(text, p, s):
    """The highest window's score, a word and a unit at a time."""
    found = []
    for w in WORD.findall(text):
        w = w.strip("".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()))
        if w:
            (b,) = words.blocks([w.encode()], strip=True)
            slot, grams, _ = toxicity_rnn.word_inputs(b, s)
            found.append(p["E_word"][slot[0]].astype(float) + sum(p["E_char"][g].astype(float) for g in grams) / np.sqrt(len(grams)))

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def states(xs, d):
        h, out = np.zeros(s.hidden), []
        for x in xs:
            a = x @ p["W" + d] + p["c" + d]
            z, r = (sigmoid(a[k * s.hidden : (k + 1) * s.hidden] + h @ p["U" + d][:, k * s.hidden : (k + 1) * s.hidden]) for k in (0, 1))
            n = np.tanh(a[2 * s.hidden :] + (r * h) @ p["U" + d][:, 2 * s.hidden :])
            h = z * h + (1 - z) * n
            out.append(h)
        return out

    best = -np.inf
    for lo, hi in toxicity_rnn.spans(len(found), s):
        own = found[lo:hi]
        both = [np.concatenate(x) for x in zip(states(own, "f"), reversed(states(own[::-1], "b")), strict=True)]
        pooled = np.zeros(2 * s.hidden)
        if both:
            e = np.exp([float(h @ p["a"]) for h in both])
            pooled = sum(w * h for w, h in zip(e / e.sum(), both, strict=True))
        best = max(best, float(pooled @ p["o"] + p["bias"][0]))
    return sigmoid(best)


def test_scores_equal_a_naive_network_over_all_windows():
    s = toxicity_rnn.Settings(window=12, stride=7)
    rng = np.random.default_rng(4)
    p = {k: (v + rng.normal(size=v.shape) * 0.4).astype(np.float32) for k, v in toxicity_rnn.initial(s).items()}
    texts = ["", " \n", "one", "One, two!", awkward.prose(1, 12), awkward.prose(2, 13), awkward.prose(3, 90), "### !! naïve É 日本 x" * 3, "word " * 40]
    got = toxicity_rnn.scores([t.encode() for t in texts], p, s)
    want = [naive_toxicity(t, p, s) for t in texts]
    assert np.allclose(got, want, atol=1e-4) and len(set(np.round(want, 3))) > 5


def test_a_toxic_word_anywhere_in_a_long_text_is_found():
    rng = random.Random(0)
    bad = ["vequra", "vequlo", "zotta"]
    texts, y = [], []
    for i in range(240):
        w = awkward.prose(i, rng.choice([10, 60, 300])).split()
        y.append(i % 4 == 0)
        if y[-1]:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w).encode())
    p = toxicity_rnn.fit(texts, [int(v) for v in y], toxicity_rnn.Settings(steps=120))
    clean = awkward.prose(999, 3000).split()
    cases = [clean, [*clean[:2700], "vequlo", *clean[2700:]], [*clean[:5], "vequxx", "zotta", *clean[5:]]]
    got = toxicity_rnn.scores([" ".join(c).encode() for c in cases], p, toxicity_rnn.Settings())
    assert got[0] < 0.3 <= min(got[1:])


@pytest.mark.parametrize("op", [toxicity_rnn, quality_ftrl])
def test_classifiers_score_every_row(spark, docs, rows, op):
    m, r = (4, 2) if op is toxicity_rnn else (5, 0)
    s = toxicity_rnn.Settings(steps=10) if op is toxicity_rnn else quality_ftrl.Settings()
    got = op.query(docs, awkward.labels(spark), s).collect()
    assert Counter(g.doc_id for g in got) == Counter(d for d, _ in rows)
    for g in got:
        assert 0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3)
        assert g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % m == r)
    assert op.query(awkward.empty(spark, docs), awkward.labels(spark), s).count() == 0
    assert op.query(docs, awkward.empty(spark, awkward.labels(spark)), s).count() == len(rows)


def test_ftrl_scores_are_sparse_dot_products():
    s = quality_ftrl.Settings(bits=12)
    texts = [awkward.prose(i, 30).encode() for i in range(20)] + [b"", b"one", b"### $$$ ###"]
    labels = [i % 2 for i in range(23)]
    data = quality_ftrl.training_rows(texts, labels, s)
    w = quality_ftrl.ftrl(data, s)
    want = [1 / (1 + np.exp(-(w[at].astype(float) @ v))) for at, v, _ in data]
    assert np.allclose(quality_ftrl.scores(texts, w, s), want, atol=1e-5)
    assert [x >= 0.5 for x in want] == [bool(y) for y in labels]


@pytest.mark.parametrize(("op", "label", "fold_of"), [(quality_ftrl, "quality", (5, 0)), (toxicity_rnn, "toxic", (4, 2))])
def test_held_out_accuracy(spark, op, label, fold_of):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = op.query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r[label] for r in got) / len(got)
    assert len(got) > 700 and right > (0.98 if op is quality_ftrl else 0.95)


# -- 10: packing


def brute_fit(sizes, sources, clusters, capacity, per):
    bins, where = [], []
    for z, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= z and (c is None or c not in b[1]) and (s is None or b[2].count(s) < per)]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), []])
        bins[i][0] -= z
        bins[i][1].add(c)
        bins[i][2].append(s)
        where.append(i)
    return where, [b[0] for b in bins]


def test_best_fit_equals_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        n = rng.randint(1, 70)
        sizes = sorted((rng.randint(0, 100) for _ in range(n)), reverse=True)
        sources = [rng.choice([None, 0, 1, 2, 3]) for _ in range(n)]
        clusters = [rng.choice([None, *range(20)]) for _ in range(n)]
        per = rng.choice([1, 2, 5])
        assert conflict_packing.best_fit(sizes, sources, clusters, 100, per) == brute_fit(sizes, sources, clusters, 100, per)


def test_bins_hold_all_documents_without_conflicts(spark, docs, rows):
    got = conflict_packing.query(docs, conflict_packing.Settings(capacity=200, group_rows=9)).collect()
    sizes, bins = Counter(), {}
    for r in got:
        sizes[r.doc_id] += r["size"]
        bins.setdefault((r.pack_group, r.bin), []).append(r)
    want = Counter()
    for d, t in rows:
        want[d] += len(WORD.findall(t or ""))
    assert sizes == want and len(got) >= len(rows)
    source = {r.doc_id: r.source for r in docs.collect()}
    for own in bins.values():
        assert sum(r["size"] for r in own) + own[0].bin_left == 200
        most = Counter(source[r.doc_id] for r in own if source[r.doc_id] is not None)
        assert not most or max(most.values()) <= 2
        assert sum(r.doc_id in (0, 1) for r in own) <= 1  # copies
    assert conflict_packing.query(awkward.empty(spark, docs)).count() == 0


def test_near_copies_share_no_bin(spark):
    rows = []
    for g in range(4):
        text = awkward.prose(50 + g, 80).split()
        for i in range(6):  # all links lead to the first: one word changed
            rows.append((len(rows), " ".join([*text[: 10 + i], f"other{i}", *text[11 + i :]] if i else text), None))
    rows += [(100, "", None), (101, None, None), (102, "alone here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = conflict_packing.query(df, conflict_packing.Settings(capacity=2048)).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    seen = Counter((r.pack_group, r.bin, r.doc_id // 6) for r in got if r.doc_id < 24)
    assert max(seen.values()) == 1
