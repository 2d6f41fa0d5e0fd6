import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions import scalars
from stratalog.functions.hashing import shard_number, shard_of
from stratalog.operators import audit, benchstats, compaction, fold, scans, sessions, shards
from stratalog.operators import versions as V
from stratalog.plans import access
from stratalog.sources.segments import Conflict, Segment, Store
from stratalog.streaming import apply

from . import models


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def versions(spark, data):
    return spark.createDataFrame(data, "key string, seq long, kind int, value string")


# -- reads


def test_point_reads_as_of(spark):
    v = versions(spark, [("k", 1, 1, "v1"), ("k", 2, 1, "v2"), ("k", 3, 0, None)])
    assert rows(V.get(v, "k", 0)) == []
    assert rows(V.get(v, "k", 2), "value") == [("v2",)]
    assert rows(V.get(v, "k", 3)) == [] and rows(V.get(v, "kk", 10)) == []


def test_scan_hides_deleted_and_respects_bounds(spark):
    data = [(k, i + 1, 1, "v" + k) for i, k in enumerate("abcde")] + [("c", 6, 0, None), ("b", 7, 1, "v2")]
    assert rows(V.scan(versions(spark, data), "b", "e"), "key", "value") == [("b", "v2"), ("d", "vd")]
    assert rows(V.scan(versions(spark, data), as_of=5), "key") == [(k,) for k in "abcde"]
    assert rows(V.scan(versions(spark, data), "x", "")) == []


def test_binary_keys_order_by_unsigned_bytes(spark):
    keys = [b"\x80", b"\x00", b"\xff", b"\x7f\x00", b"\x7f"]
    v = spark.createDataFrame([(bytearray(k), i, 1, bytearray(b"")) for i, k in enumerate(keys)], "key binary, seq long, kind int, value binary")
    assert [bytes(r.key) for r in V.scan(v).collect()] == sorted(keys)


@pytest.mark.parametrize(("limit", "n"), [(0, 4), (1, 1), (6, 1), (7, 2), (12, 2), (1000, 4)])
def test_byte_bound_includes_the_crossing_pair(spark, limit, n):
    pairs = spark.createDataFrame([(k, "12345") for k in "abcd"], "key string, value string")
    assert len(rows(scans.bounded(pairs, max_bytes=limit))) == n


def test_merged_scan_and_group_bounds(spark):
    pairs = spark.createDataFrame([(i % 3, chr(97 + i), chr(97 + i)) for i in range(26)], "grp long, key string, value string")
    assert [r.key for r in scans.merged(pairs).collect()] == [chr(97 + i) for i in range(26)]
    assert [r.key for r in scans.merged(pairs.where("key >= 'f' and key < 'k'"), limit=3).collect()] == ["f", "g", "h"]
    assert [r.key for r in scans.merged(pairs, max_bytes=4).collect()] == ["a", "b"]
    assert [r.key for r in scans.merged(pairs, max_bytes=4, compat_per_group_bound=True).collect()] == list("abcdef")


def test_pages_cover_everything_once(spark):
    v = versions(spark, [(f"k{i:02d}", i, 1, "v") for i in range(25)])
    got, after = [], None
    while page := [r.key for r in scans.page(v, after, 10).collect()]:
        got, after = got + page, page[-1]
    assert got == [f"k{i:02d}" for i in range(25)]


def test_empty_key_is_refused(spark):
    batch = spark.createDataFrame([(0, "", "v")], "pos long, key string, value string")
    with pytest.raises(Exception, match="empty key"):
        V.put(versions(spark, []), batch, 0).collect()


# -- folds and sessions


def log(spark, data):
    names = "idx long, client_id long, req_seq long, op string, key string, value string, expected string"
    return spark.createDataFrame(data, names)


def test_cas_sequence(spark):
    data = [(1, 0, 0, "cas", "k", "1", None), (2, 0, 0, "cas", "k", "x", None), (3, 0, 0, "cas", "k", "x", "2"), (4, 0, 0, "cas", "k", "2", "1")]
    assert rows(fold.results(log(spark, data)), "idx", "success") == [(1, True), (2, False), (3, False), (4, True)]
    assert rows(fold.state(log(spark, data))) == [("k", "2")]


def test_an_empty_expectation_is_not_an_absent_one(spark):
    data = [(1, 0, 0, "put", "k", "", None), (2, 0, 0, "cas", "k", "x", None), (3, 0, 0, "cas", "k", "y", "")]
    assert rows(fold.results(log(spark, data)), "idx", "success") == [(1, True), (2, False), (3, True)]


def test_sessions_replay_the_latest_reply(spark):
    data = [(1, 0, 0, "register", None, None, None), (2, 1, 1, "cas", "k", "v1", None), (3, 1, 1, "cas", "k", "v1", None), (4, 1, 0, "put", "k", "stale", None)]
    m = sessions.mark_duplicates(log(spark, data))
    assert rows(m, "idx", "dup") == [(1, False), (2, False), (3, True), (4, True)]
    got = rows(sessions.replies(m, fold.results(m.where("not dup and op <> 'register'"))), "idx", "success")
    assert got[1:] == [(2, True), (3, True), (4, True)]


@pytest.mark.parametrize("seed", range(3))
def test_folds_equal_a_dictionary(spark, seed):
    rng = random.Random(seed)
    data = [(i + 1, 0, 0, rng.choice(["put", "delete", "cas", "cas", "get"]), f"k{rng.randrange(6)}", str(rng.randrange(3)), rng.choice([None, "0", "1", ""])) for i in range(400)]
    state, replies = models.replay([dict(zip(("idx", "client_id", "req_seq", "op", "key", "value", "expected"), r, strict=True)) for r in data])
    for long_run in (2000, 3):
        got = {r.idx: (r.found, r.value, r.success) for r in fold.results(log(spark, data), long_run).collect()}
        assert got == {i: r[:3] for i, (_, r) in replies.items()}
    assert dict(rows(access.state(log(spark, data)))) == state


@pytest.mark.parametrize("seed", range(4))
def test_whole_replay_equals_the_model(spark, seed):
    rng = random.Random(seed)
    data = []
    for i in range(300):
        op = rng.choice(["put", "put", "delete", "cas", "get", "freeze", "import", "purge", "put", "get"]) if i % 40 else "register"
        key = f"key{rng.randrange(12)}"
        client = 0 if op in ("freeze", "import", "purge", "register") else rng.choice([0, 1, 3, 41, 81])
        kvs = [(f"key{rng.randrange(12)}", "i") for _ in range(2)] if op == "import" else None
        shard = shard_number(kvs[0][0]) if kvs else shard_number(key)
        kvs = [p for p in dict(kvs).items() if shard_number(p[0]) == shard] if kvs else None
        data.append({"grp": 1, "idx": i + 1, "client_id": client, "req_seq": rng.randrange(1, 3 + i // 4), "op": op, "key": key, "value": f"v{i}", "expected": rng.choice([None, "i", f"v{i - 1}"]), "shard": shard, "kvs": kvs, "last": rng.random() < 0.7})
    schema = "grp long, idx long, client_id long, req_seq long, op string, key string, value string, expected string, shard int, kvs array<struct<key:string,value:string>>, last boolean"
    state, replies = models.replay(data)
    got_state, got = shards.replay(spark.createDataFrame(data, schema))
    assert {r.key: r.value for r in got_state.collect()} == state
    for r in got.collect():
        dup, want = replies[r.idx]
        assert r.dup == dup
        if want is not None:
            assert (r.found, r.value, r.success, r.client_id, r.moving) == want, (r, want)


# -- shards


def test_shard_hash(spark):
    assert [shard_number(f"key{i}") for i in range(10)] == [1, 13, 13, 12, 3, 12, 6, 12, 7, 13]
    keys = [f"key{i}" for i in range(64)] + ["", "é", "日本語"]
    got = {r.k: r.s for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", shard_of(F.col("k")).alias("s")).collect()}
    assert got == {k: shard_number(k) for k in keys}
    counts = [0] * 16
    for i in range(10000):
        counts[shard_number(f"key{i}")] += 1
    assert min(counts) >= 10000 // 16 // 3


def test_default_map(spark):
    assert rows(shards.default_map(spark, [4, 3, 2]), "grp", "shard") == sorted(((2 + i % 3, i) for i in range(16)), key=str)


def test_import_lifecycle(spark):
    ops = [("import", False), ("import", False), ("import", True), ("import", True), ("freeze", None), ("import", True), ("purge", None), ("freeze", None), ("import", True)]
    admin = spark.createDataFrame([(1, 5, i, op, last) for i, (op, last) in enumerate(ops)], "grp long, shard int, idx long, op string, last boolean")
    got = [(r.accepted, r.state) for r in shards.timeline(admin).orderBy("idx").collect()]
    assert got == [(True, None), (True, None), (True, 0), (False, 0), (True, 1), (False, 1), (True, 2), (True, 2), (True, 0)]


def test_state_as_of_by_window_equals_intervals(spark, monkeypatch):
    admin = spark.createDataFrame([(1, i % 2, i * 3, "freeze" if i % 3 else "purge", None) for i in range(30)], "grp long, shard int, idx long, op string, last boolean")
    asked = spark.createDataFrame([(1, i % 2, i) for i in range(90)], "grp long, shard int, idx long")
    line = shards.timeline(admin)
    a = rows(shards.with_state(asked, line), "shard", "idx", "state")
    monkeypatch.setattr(shards, "SMALL", 0)
    assert a == rows(shards.with_state(asked, line), "shard", "idx", "state")


def test_move_changes_one_shard_and_can_be_repeated(spark):
    pairs = spark.createDataFrame([(f"key{i}", str(i)) for i in range(200)], "key string, value string")
    m = shards.default_map(spark, [2, 3])
    at = shards.route(pairs, m).select("grp", "key", "value")
    moved, flipped, steps = shards.move(at, m, 13, 2)
    assert steps == ["mark", "freeze@3", "import@2", "purge@3", "flip"] and moved.count() == 200
    assert {r.grp for r in moved.where(shard_of(F.col("key")) == 13).collect()} == {2}
    assert shards.owned(moved, flipped).count() == 200 and shards.owned(at, flipped).count() < 200
    assert shards.move(moved, flipped, 13, 2)[2] == []


def test_import_chunks_are_greedy(spark):
    pairs = [("p", f"k{i:03d}", "x" * (i * 37 % 50)) for i in range(100)]
    want, chunk, n, size = [], 0, 0, 0
    for _, k, v in pairs:
        s = len(k) + len(v)
        if n >= 7 or (n and size + s > 120):
            chunk, n, size = chunk + 1, 0, 0
        n, size = n + 1, size + s
        want.append(chunk)
    got = shards.import_chunks(spark.createDataFrame(pairs, "part string, key string, value string"), 7, 120).orderBy("key").collect()
    assert [r.chunk for r in got] == want


# -- segments


def test_pick_equals_the_model():
    rng = random.Random(1)
    for _ in range(500):
        sizes = [rng.choice([1, 2, 3, 5, 9, 20, 50]) for _ in range(rng.randrange(0, 16))]
        assert [s.num for s in compaction.pick([Segment(i, b) for i, b in enumerate(sizes)])] == models.pick(sizes)


def test_store_against_a_dictionary(spark, tmp_path):
    rng = random.Random(2)
    store, model, history = Store(spark, f"file://{tmp_path}/t"), {}, []
    for step in range(6):
        batch = [(i, f"k{rng.randrange(30):02d}", None if rng.random() < 0.3 else f"v{step}-{i}") for i in range(25)]
        store.write(spark.createDataFrame(batch, "pos long, key string, value string"))
        for _, k, v in batch:
            model.pop(k, None) if v is None else model.__setitem__(k, v)
        history.append((store.manifest().max_seq, dict(model)))
        if step == 3:
            held = store.versions()
            before = rows(V.state(held), "key", "value")
            assert len(store.compact().segments) == 1
            assert rows(V.state(held), "key", "value") == before  # an older snapshot stays readable
            assert rows(store.versions().where("kind = 0")) == []  # the output is the oldest segment
    assert dict(rows(store.scan(), "key", "value")) == model
    assert dict(rows(store.scan("k05", "k20"), "key", "value")) == {k: v for k, v in model.items() if "k05" <= k < "k20"}
    assert dict(rows(store.scan(as_of=history[4][0]), "key", "value")) == history[4][1]
    key = next(iter(model))
    assert rows(store.get(key), "value") == [(model[key],)] and "PartitionFilters: [isnotnull(shard" in store.get(key)._jdf.queryExecution().toString()
    store.export(f"file://{tmp_path}/x")
    other = Store(spark, f"file://{tmp_path}/u")
    other.restore(f"file://{tmp_path}/x")
    assert rows(V.equal(store.scan().select("key", "value"), other.scan().select("key", "value"))) == []
    assert other.manifest().max_seq <= store.manifest().max_seq
    store.delete(key)
    assert rows(store.get(key)) == [] and store.vacuum() and len(rows(store.scan())) == len(model) - 1


def test_compaction_keeps_tombstones_above_older_segments(spark):
    v = versions(spark, [("a", 5, 0, None), ("a", 4, 1, "x"), ("b", 6, 1, "y")])
    assert rows(compaction.compact(v, bottom=False), "key", "kind") == [("a", 0), ("b", 1)]
    assert rows(compaction.compact(v, bottom=True), "key") == [("b",)]


def test_second_writer_conflicts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t")
    m = store.put("a", "1")
    with pytest.raises(Conflict):
        store._commit(m)
    with pytest.raises(ValueError, match="empty key"):
        store.put("", "x")


# -- audits and statistics


def test_audits_flag_seeded_faults(spark):
    names = "grp long, node long, event_no long, term long, state string, leader long"
    good = [(1, 1, 1, 1, "leader", 1), (1, 2, 1, 1, "follower", 1), (1, 1, 2, 2, "follower", 2), (1, 2, 2, 2, "leader", 2)]
    assert audit.leaders_per_term(spark.createDataFrame(good, names)).isEmpty() and audit.term_regressions(spark.createDataFrame(good, names)).isEmpty()
    bad = [*good, (1, 1, 3, 2, "leader", 1), (1, 2, 3, 1, "follower", 1)]
    assert rows(audit.leaders_per_term(spark.createDataFrame(bad, names))) == [(1, 2, 2)]
    assert rows(audit.term_regressions(spark.createDataFrame(bad, names))) == [(1, 2, 3, 2, 1)]
    e = spark.createDataFrame([(1, n, i, 1, 1 if i == 2 else 0, "x" if (n, i) != (2, 3) else "y") for n in (1, 2) for i in range(1, 5)], "grp long, node long, idx long, term long, entry_type int, data_hash string")
    assert rows(audit.disagreements(e)) == [(1, 3, 2)]
    done = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 2, 3), (1, 1, 3, 4), (1, 2, 1, 1), (1, 2, 2, 4), (1, 2, 3, 4)], "grp long, node long, event_no long, idx long")
    assert rows(audit.apply_gaps(done, e), "node", "idx", "reason") == [(2, 3, "skipped"), (2, 4, "order")]
    r = spark.createDataFrame([(1, 1, 5, 7, 0), (1, 2, 5, 9, 0), (1, 3, 5, 7, 8)], "grp long, node long, event_no long, last_idx long, snap_idx long")
    c = spark.createDataFrame([(1, n, 4, 8) for n in (1, 2, 3)], "grp long, node long, event_no long, commit long")
    assert rows(audit.lost_commits(r, c), "node") == [(1,)]


def test_linearizability(spark):
    names = "key string, kind string, value string, expected string, absent boolean, out_value string, out_found boolean, out_ok boolean, call_ns long, return_ns long"
    ops = [
        ("ok", "put", "a", None, None, None, None, True, 0, 10), ("ok", "get", None, None, None, "", False, None, 1, 5), ("ok", "get", None, None, None, "a", True, None, 6, 7),
        ("ok", "cas", "b", "a", False, "a", True, True, 11, 12), ("ok", "delete", None, None, None, None, None, True, 13, 14), ("ok", "cas", "c", None, True, "", False, True, 15, 16),
        ("lost", "put", "a", None, None, None, None, True, 0, 1), ("lost", "get", None, None, None, "", False, None, 2, 3),
    ]
    h = spark.createDataFrame(ops, names)
    assert rows(audit.linearizable(h), "key", "verdict") == [("lost", "violation"), ("ok", "ok")]
    assert rows(audit.linearizable(h, 1), "verdict") == [("unknown",), ("unknown",)]


def test_long_histories_are_decided_by_the_states_held(spark):
    names = "key string, kind string, value string, expected string, absent boolean, out_value string, out_found boolean, out_ok boolean, call_ns long, return_ns long"
    ops = []
    for k, wrong in (("late", 2999), ("long", None)):
        for i in range(3000):  # puts and gets in turn; every tenth pair overlaps
            get = i % 2
            value = f"v{i - get}" if i != wrong else "lost"
            ops.append((k, "get" if get else "put", None if get else value, None, None, value if get else None, bool(get), None, 10 * i, 10 * i + (12 if i % 20 == 0 else 5)))
    h = spark.createDataFrame(ops, names)
    assert rows(audit.linearizable(h, 20), "key", "operations", "verdict") == [("late", 3000, "violation"), ("long", 3000, "ok")]


def test_linearizability_equals_all_orders():
    import itertools
    import random

    rng = random.Random(0)
    seen = set()
    for _ in range(400):
        ops = []
        for i in range(rng.randint(1, 6)):
            call = rng.randrange(20)
            kind = rng.choice(["put", "get", "delete", "cas"])
            out = rng.choice(["", "a", "b"])
            absent = rng.random() < 0.3
            expected = None if absent else rng.choice(["a", "b"])
            ok = out == "" if absent else out == expected
            ops.append({"key": "k", "kind": kind, "value": rng.choice("ab"), "expected": expected, "absent": absent, "out_value": out, "out_found": out != "", "out_ok": ok, "call_ns": call, "return_ns": call + rng.randrange(1, 8)})

        def explains(order):
            state = ""
            for j, op in enumerate(order):
                if any(later["return_ns"] < op["call_ns"] for later in order[j + 1 :]):
                    return False
                state = audit._apply(state, op)
                if state is None:
                    return False
            return True

        search = audit._Search("k", 10_000)
        for op in sorted(ops, key=lambda r: (r["call_ns"], r["return_ns"])):
            search.add(op)
        want = "ok" if any(explains(p) for p in itertools.permutations(ops)) else "violation"
        assert search.verdict() == want
        seen.add(want)
    assert len(seen) == 2


def test_rank_percentiles_are_floor_ranks(spark):
    s = spark.createDataFrame([("m", i) for i in range(100)], "m string, v long")
    assert rows(benchstats.latency(s, "m", "v")) == [("m", 100, 50, 99, 99)]


def test_scalars(spark):
    x = [0.0, 0.125, 42.55, 56.55, 99.95, 100.5, 999.5, 1234.0, 2.5e6]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(scalars.short_number(F.col("x"))).collect()]

    def plain(v):
        return f"{v / 1e6:.1f}M" if v >= 1e6 else f"{v / 1e3:.1f}k" if v >= 1e3 else f"{v:.0f}" if v >= 100 else f"{v:.1f}" if v >= 10 else f"{v:.2f}"

    assert got == [plain(v) for v in x]
    big = spark.createDataFrame([("k", "v" * 1048575), ("k", "v" * 1048576)], "k string, v string")
    assert [r[0] for r in big.select(scalars.fits(F.col("k"), F.col("v"))).collect()] == [True, False]
    s = spark.createDataFrame([(1,)], "i long")
    assert bytes(s.select(scalars.session_key(F.col("i"))).collect()[0][0]) == b"s" + (1).to_bytes(8, "big")


# -- streams


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    rng = random.Random(3)
    data = [(i + 1, rng.choice(["put", "delete", "cas", "get"]), f"k{rng.randrange(5)}", str(i), rng.choice([None, str(i - 1)])) for i in range(200)]
    at = f"file://{tmp_path}"
    for part in range(2):
        some = data[part * 100 : part * 100 + 100]
        spark.createDataFrame(some, apply.LOG).coalesce(1).write.mode("append").parquet(f"{at}/log")
        out = apply.run_available(apply.results(apply.read_log(spark, f"{at}/log")), f"{at}/out", f"{at}/ck")
    whole = log(spark, [(i, 0, 0, op, k, v, e) for i, op, k, v, e in data])
    assert rows(out, "idx", "found", "value", "success") == rows(fold.results(whole), "idx", "found", "value", "success")
    assert rows(apply.last_states(out)) == rows(fold.state(whole))


def test_command_line(spark, tmp_path):
    from stratalog import cli

    def call(*a):
        return cli.run(spark, cli.parser().parse_args([f"file://{tmp_path}/t", *a]))

    assert call("put", "a", "1") == ["seq 1"] and call("cas", "a", "2", "--expected", "1") == ["success true", "found 1"]
    assert call("cas", "a", "3") == ["success false", "found 2"] and call("get", "a") == ["2"] and call("get", "a", "--as-of", "1") == ["1"]
    assert call("delete", "zz") == ["seq 3"] and call("scan", "--limit", "5") == ["a\t2"] and call("get", "zz") == ["not found"]
    assert len(call("shards")) == 1 and call("compact") == ["segments 3"] and "segments\t3" in call("stats")


def test_bench_result_files(spark, tmp_path):
    import json

    from stratalog.sources import bench_results

    for name, x in {"b": {"name": "b", "op": "put", "ops": 10, "throughput": 2.5, "p50": 7}, "a": {"name": "a", "op": "get", "ops": 5, "throughput": 1.0}, "failover": {"killed_at": 1, "timeline": [1]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(x, indent=1))
    got = bench_results.read(spark, f"file://{tmp_path}/*.json").collect()
    assert [(r.name, r.ops) for r in got] == [("a", 5), ("b", 10)]


def test_fit_batch_first_entry_always_goes(spark):
    e = spark.createDataFrame([(1, 1, 500), (1, 2, 10), (2, 1, 5), (2, 2, 6), (2, 3, 90)], "grp long, idx long, size long")
    assert rows(scans.fit_batch(e, 10, 100), "grp", "idx") == [(1, 1), (2, 1), (2, 2)]
