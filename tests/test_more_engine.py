import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog import cli
from stratalog.operators import audit, fold, moves, ordered, scans, shards
from stratalog.sources import log_files
from stratalog.streaming import apply

from . import models


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(rng.choice([1, 2, None]), t, rng.randrange(50)) for t in rng.sample(range(5000), 400)]
    return spark.createDataFrame(data, "g long, t long, x long").cache()


@pytest.mark.parametrize("size", [7, 1000])
def test_chunked_windows_equal_whole_ones(rows, size):
    order = Window.partitionBy("g").orderBy("t")
    same(ordered.running_sum(rows, ["g"], "t", F.col("x"), "s", size), rows.withColumn("s", F.sum("x").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    same(ordered.previous(rows, ["g"], "t", {"p": "x", "q": "t"}, size), rows.withColumn("p", F.lag("x").over(order)).withColumn("q", F.lag("t").over(order)))
    same(ordered.least_behind(rows, ["g"], "t", "x", "m", size), rows.withColumn("m", F.min("x").over(order.rowsBetween(1, Window.unboundedFollowing))))
    none = rows.where("t < 0")
    assert ordered.running_sum(none, ["g"], "t", F.col("x"), "s", size).count() == 0


@pytest.mark.parametrize("long_run", [0, 3, 500])
def test_folds_of_several_groups_equal_the_model(spark, long_run):
    rng = random.Random(long_run)
    data = []
    for g in (1, 2):
        for i in range(1, 160):
            op = rng.choice(["put", "delete", "cas", "cas", "cas", "get"])
            data.append((g, i, f"k{min(rng.randrange(9), 3)}", op, rng.choice("ab"), rng.choice([None, "a", "b"])))
    log = spark.createDataFrame(data, "grp long, idx long, key string, op string, value string, expected string")
    want_state, want = [], []
    for g in (1, 2):
        own = [{"idx": i, "client_id": 0, "req_seq": 0, "op": op, "key": k, "value": v, "expected": e} for h, i, k, op, v, e in data if h == g]
        state, replies = models.replay(own)
        want_state += [(g, k, v) for k, v in state.items()]
        want += [(g, i, r[0], r[1], r[2]) for i, (_, r) in replies.items()]
    assert sorted(map(tuple, fold.state(log, long_run).select("grp", "key", "value").collect())) == sorted(want_state)
    got = fold.results(log, long_run).select("grp", "idx", "found", "value", "success")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_purges_of_each_group_delete_its_own_keys(spark):
    rng = random.Random(4)
    schema = "grp long, idx long, client_id long, req_seq long, op string, key string, value string, expected string, shard int, kvs array<struct<key:string,value:string>>, last boolean"
    data = []
    for g in (2, 3):
        for i in range(1, 90):
            op = rng.choice(["put", "put", "get", "delete", "cas", "freeze", "import", "purge"])
            key = f"key{rng.randrange(6)}"
            admin = op in ("freeze", "import", "purge")
            data.append((g, i, 0 if admin else rng.randrange(3), i - rng.randrange(4), op, key, f"v{g}-{i}", rng.choice([None, "x"]), models.shard_number(key), [(key, f"i{g}-{i}")], rng.random() < 0.7))
    names = [x.split()[0] for x in schema.split(", ")]
    state, replies = shards.replay(spark.createDataFrame(data, schema))
    want_state, want = [], []
    for g in (2, 3):
        s, r = models.replay([dict(zip(names, row, strict=True)) for row in data if row[0] == g])
        want_state += [(g, k, v) for k, v in s.items()]
        want += [(g, i, d, *x[:2], x[2], x[4]) for i, (d, x) in r.items()]
    assert sorted(map(tuple, state.collect())) == sorted(want_state)
    got = replies.select("grp", "idx", "dup", "found", "value", "success", "moving").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_scans_with_bounds_equal_the_model(spark, monkeypatch):
    monkeypatch.setattr(scans, "SCAN_KEYS", 2)
    monkeypatch.setattr(scans, "TIMES", 5)
    rng = random.Random(2)
    writes = [(f"k{rng.randrange(30):02d}", i, int(rng.random() < 0.7)) for i in range(1, 300, 2)]
    versions = spark.createDataFrame([(k, i, kind, f"v{i}" if kind else None) for k, i, kind in writes], "key string, seq long, kind int, value string")
    asked = [(i, rng.choice([None, f"k{rng.randrange(30):02d}"]), rng.choice([None, "", f"k{rng.randrange(30):02d}"]), rng.choice([0, 0, 1, 4]), rng.choice([0, 0, 9, 30])) for i in range(2, 340, 8)]
    got = scans.scan_commands(spark.createDataFrame(asked, "idx long, scan_start string, scan_end string, scan_limit int, scan_max_bytes int"), versions).collect()
    want = []
    for idx, lo, hi, limit, most in asked:
        state = {}
        for k, i, kind in writes:
            if i < idx:
                state[k] = f"v{i}" if kind else None
        n = size = 0
        for k in sorted(k for k, v in state.items() if v is not None and k >= (lo or "") and (not hi or k < hi)):
            if (limit and n >= limit) or (most and size >= most):
                break
            want.append((idx, k, state[k]))
            n, size = n + 1, size + len(k) + len(state[k])
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_scans_cut_by_indexes_over_many_ranges_equal_the_model(spark, monkeypatch):
    monkeypatch.setattr(scans, "SCAN_KEYS", 2)
    monkeypatch.setattr(scans, "SWEEP_ROWS", 9, raising=False)
    rng = random.Random(5)
    writes = [(f"k{rng.randrange(40):02d}" if rng.random() < 0.7 else "k07", i, int(rng.random() < 0.7)) for i in range(1, 600, 2)]
    versions = spark.createDataFrame([(k, i, kind, f"v{i}" if kind else None) for k, i, kind in writes], "key string, seq long, kind int, value string")
    asked = [(i, rng.choice([None, f"k{rng.randrange(40):02d}"]), rng.choice([None, None, "", f"k{rng.randrange(40):02d}"]), rng.choice([0, 1, 4, 30]), rng.choice([0, 0, 9, 200])) for i in range(2, 640, 8)]
    got = scans.scan_commands(spark.createDataFrame(asked, "idx long, scan_start string, scan_end string, scan_limit int, scan_max_bytes int"), versions)
    want = []
    for idx, lo, hi, limit, most in asked:
        state = {}
        for k, i, kind in writes:
            if i < idx:
                state[k] = f"v{i}" if kind else None
        n = size = 0
        for k in sorted(k for k, v in state.items() if v is not None and k >= (lo or "") and (not hi or k < hi)):
            if (limit and n >= limit) or (most and size >= most):
                break
            want.append((idx, k, state[k]))
            n, size = n + 1, size + len(k) + len(state[k])
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    # Plans double with every round where a plan holds those of the rounds before.
    assert got._jdf.queryExecution().executedPlan().toString().count("\n") < 3000


def test_a_batch_of_a_store_is_numbered_in_parts_and_computed_once(spark, tmp_path, monkeypatch):
    from stratalog.operators import versions as V
    from stratalog.sources.segments import Store

    monkeypatch.setattr(V, "NUMBERED", 10, raising=False)
    computed = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            computed.add(b.num_rows)
            yield b

    rows = [(i * 3 + 7, f"k{i % 40:02d}", None if i % 9 == 0 else str(i)) for i in range(200)]
    random.Random(3).shuffle(rows)
    schema = "pos long, key string, value string"
    store = Store(spark, f"file://{tmp_path}/t")
    store.write(spark.createDataFrame(rows, schema).mapInArrow(seen, schema))
    # Size and range of the batch, sums of its parts, and the rows themselves.
    assert computed.value <= 3 * len(rows)
    got = [(r.seq, r.key, r.value) for r in store.versions().collect()]
    assert sorted(got) == [(n + 1, k, v) for n, (_, k, v) in enumerate(sorted(rows))]
    with pytest.raises(ValueError):
        store.write(spark.createDataFrame([(1, "a", "1"), (2, "", "2")], schema))
    assert store.stats()["entries"] == 200 and store.stats()["max_seq"] == 200


def test_a_stream_keeps_few_entries_for_many_keys(spark, tmp_path):
    rng = random.Random(4)
    data = [(i + 1, rng.choice(["put", "delete", "cas", "get"]), f"k{rng.randrange(3000)}", str(i), rng.choice([None, str(i - 1)])) for i in range(8000)]
    at = f"file://{tmp_path}"
    for part in range(2):
        some = data[part * 4000 : part * 4000 + 4000]
        rng.shuffle(some)
        spark.createDataFrame(some, apply.LOG).repartition(3).write.mode("append").parquet(f"{at}/log")
        out = apply.run_available(apply.results(apply.read_log(spark, f"{at}/log", 100)), f"{at}/out", f"{at}/ck")
    assert spark.read.format("statestore").load(f"{at}/ck").count() <= 1024
    whole = spark.createDataFrame(data, apply.LOG)
    columns = ["idx", "found", "value", "success"]
    assert sorted(map(tuple, out.select(columns).collect()), key=str) == sorted(map(tuple, fold.results(whole).select(columns).collect()), key=str)
    assert sorted(map(tuple, apply.last_states(out).collect())) == sorted(map(tuple, fold.state(whole).collect()))


def test_a_replay_computes_its_log_once(spark):
    computed = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            computed.add(b.num_rows)
            yield b

    schema = "grp long, idx long, client_id long, req_seq long, op string, key string, value string, expected string, shard int, kvs array<struct<key:string,value:string>>, last boolean"
    ops = ["put", "get", "cas", "freeze", "import", "purge", "delete"]
    data = [(1, i, 0, 0, ops[i % 7], f"k{i % 5}", str(i), None, models.shard_number(f"k{i % 5}"), [(f"k{i % 5}", f"i{i}")], True) for i in range(1, 200)]
    names = [x.split()[0] for x in schema.split(", ")]
    state, replies = shards.replay(spark.createDataFrame(data, schema).mapInArrow(seen, schema))
    want, want_replies = models.replay([dict(zip(names, row, strict=True)) for row in data])
    assert sorted(map(tuple, state.select("key", "value").collect())) == sorted(want.items())
    assert {r.idx: r.success for r in replies.collect()} == {i: x[2] for i, (_, x) in want_replies.items()}
    assert computed.value == len(data)


def test_a_move_goes_on_where_it_was_stopped(spark, tmp_path):
    groups = moves.Groups(spark, f"file://{tmp_path}")
    assert groups.create_map([2, 3]) == groups.create_map([4])  # the second finds the first one's
    keys = [f"key{i}" for i in range(60)]
    old = groups.map()
    shard = models.shard_number("key0")
    source = old[shard][0]
    to = 5 - source
    rows = [(old[models.shard_number(k)][0], i + 1, 0, 0, "put", k, f"v{i}", None, models.shard_number(k), None, None) for i, k in enumerate(keys)]
    groups.append(spark.createDataFrame(rows, moves.LOG))
    assert groups.move(shard, source) == []
    with pytest.raises(ValueError):
        groups.move(99, 2)
    taken = [groups.move(shard, to, max_rows=1, stop_before=s) for s in ("freeze", "import", "purge", "flip", None)]
    assert taken == [["mark"], [f"freeze@{source}"], [f"import@{to}"], [f"purge@{source}"], ["flip"]]
    assert groups.map() == old | {shard: (to, 0)}
    held = {(r.grp, r.key): r.value for r in groups.pairs().collect()}
    assert held == {(groups.map()[models.shard_number(k)][0], k): f"v{i}" for i, k in enumerate(keys)}
    with pytest.raises(moves.StaleMap):
        groups.swap(old, old)
    lines = cli.run(spark, cli.parser().parse_args([f"file://{tmp_path}", "move", str(shard), str(source)]))
    assert lines == ["mark", f"freeze@{to}", f"import@{source}", f"purge@{to}", "flip"] and groups.map() == old
    assert {(r.grp, r.key) for r in shards.owned(groups.pairs(), groups.map_rows()).collect()} == {(old[models.shard_number(k)][0], k) for k in keys}


def test_only_the_newest_log_file_may_be_torn(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)

    def read():
        got = log_files.read(spark, f"file://{tmp_path}", "idx long, op string").orderBy("_file", "_line").collect()
        return [(r.idx, r.op) for r in got]

    write("000001.log", '{"idx": 1, "op": "put"}\n{"idx": 2, "op": "get"}\n')
    write("000002.log", '{"idx": 3, "op": "put"}\n{"idx": 4, "o')
    assert read() == [(1, "put"), (2, "get"), (3, "put")]
    write("000002.log", '{"idx": 3, "op": "put"}\n{"idx": 4, "op": "cas"}')
    assert read()[-1] == (4, "cas")
    write("000002.log", '{"idx": 3, "op": "put"}\n{"idx": 4, "o\n')
    with pytest.raises(log_files.CorruptLog):
        read()
    write("000002.log", '{"idx": 3, "op": "put"}\n')
    write("000001.log", '{"idx": 1, "op": "put"}\n{"idx": 2, "op"')
    with pytest.raises(log_files.CorruptLog):
        read()


def test_proposals_and_journals(spark):
    p = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 1, 1)], "grp long, idx long, term long")
    e = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "grp long, idx long, term long")
    got = {(r.grp, r.idx): r.outcome for r in audit.settled(p, e).collect()}
    assert got == {(1, 1): "committed", (1, 2): "rejected", (1, 3): "pending", (2, 1): "pending"}
    records = [(1, 0, "entry", 1, 1), (1, 1, "entry", 2, 1), (1, 2, "state", None, 2), (1, 3, "entry", 2, 2), (1, 4, "entry", 3, 2), (1, 5, "snapshot", 2, 2), (2, 0, "entry", 1, 1)]
    journal = spark.createDataFrame(records, "grp long, pos long, kind string, idx long, term long")
    assert sorted(map(tuple, audit.repaired(journal).select("grp", "pos", "idx", "term").collect())) == [(1, 4, 3, 2), (2, 0, 1, 1)]
    assert [tuple(r) for r in audit.hard_state(journal).collect()] == [(1, 2, 2)]
