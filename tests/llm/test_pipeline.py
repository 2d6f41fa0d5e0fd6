import duckdb
import pytest

import corpus_pipeline
from stratalog.llm import decision_list, decontaminate, quality_ftrl, queries

from . import awkward
from . import test_operators as ops
from ..test_queries import TABLES, plain


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = plain(tuple(r[c] for c in columns) for r in df.collect())
    if name not in queries.ORACLES:
        assert got
        return
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cur = c.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns and got == plain(tuple(r[names.index(k)] for k in columns) for r in cur.fetchall())


def test_stages_keep_columns_and_only_drop_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "near_duplicates", "benchmark_decontamination", "best_fit_packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, data).cache()
        assert after.columns == docs.columns, name
        assert after.exceptAll(before).isEmpty() and 0 < after.count() <= before.count(), name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, data)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in before.collect()}
    clean = spark.read.parquet(f"{data}/labels.parquet").where("quality = 1 and toxic = 0")
    assert before.join(clean, "doc_id").count() > 0


def test_stages_equal_brute_force(spark, data):
    """Each stage on the rows that the one before kept, against a plain version of its method."""
    docs = [r.asDict() for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    table = spark.createDataFrame(docs, schema)

    weights = quality_ftrl.train(table, labels, quality_ftrl.learnable())
    stage = dict(corpus_pipeline.STAGES)
    scored = quality_ftrl.score(table.select("doc_id", "text"), weights)
    kept = {r.doc_id for r in stage["quality_classifier"](spark, table, data).collect()}
    assert kept == {r.doc_id for r in scored.collect() if r.score >= 0.3}
    docs = [d for d in docs if d["doc_id"] in kept]

    table = spark.createDataFrame(docs, schema)
    rules = decision_list.train(table, labels)
    kept = {r.doc_id for r in stage["quality_rules"](spark, table, data).collect()}

    def passes(text):
        n, chars, symbols, dup_lines, repeats = ops.brute_statistics(text)
        lines = sum(1 for x in (text or "").split("\n") if ops.WORD.search(x))
        capitals = sum("A" <= c <= "Z" for c in text or "")
        one, rows = max(n, 1), max(lines, 1)
        stats = dict(zip(decision_list.FEATURES, (n, chars / one, symbols / one, capitals / one, dup_lines / rows, repeats / one, n / rows), strict=True))
        return n >= 50 and 100 * repeats <= 50 * n and not any(all(c.holds(stats) for c in rule) for rule in rules)

    assert kept == {d["doc_id"] for d in docs if passes(d["text"])}
    docs = [d for d in docs if d["doc_id"] in kept]

    kept = {r.doc_id for r in stage["near_duplicates"](spark, spark.createDataFrame(docs, schema), data).collect()}
    parts = ops.brute_components([(d["doc_id"], d["text"]) for d in docs], 5, 80)
    assert kept == {part for _, n, part in parts if n} | {d for d, n, _ in parts if not n}
    docs = [d for d in docs if d["doc_id"] in kept]

    kept = {r.doc_id for r in stage["benchmark_decontamination"](spark, spark.createDataFrame(docs, schema), data).collect()}
    s = decontaminate.Settings()
    known = [(t or "", {w for f in ops.naive_forms(t or "") for w in (x[0] for x in f)}) for _, t in items]

    def dirty(text):
        own = {w for f in ops.naive_forms(text or "") for w in (x[0] for x in f)}
        # An item that shares few of its words cannot match half of its windows: a plain pre-check.
        return any(len(own & w) * 4 >= len(w) and ops.naive_contaminated(text or "", t, s) for t, w in known)

    short = [d for d in docs if len((d["text"] or "").split()) <= 400]
    assert {d["doc_id"] for d in short} - kept == {d["doc_id"] for d in short if dirty(d["text"])}
    docs = [d for d in docs if d["doc_id"] in kept]

    packed = stage["best_fit_packing"](spark, spark.createDataFrame(docs, schema), data).collect()
    size = {d["doc_id"]: len(ops.WORD.findall(d["text"] or "")) for d in docs}
    source = {d["doc_id"]: d["source"] for d in docs}
    groups = {}
    for r in packed:
        groups.setdefault(r.pack_group, []).append(r)
    assert sum(r["size"] for r in packed) == sum(size.values())
    for own in groups.values():
        order = sorted(own, key=lambda r: -r["size"])
        bins = {}
        for r in order:
            bins.setdefault(r.bin, []).append(r)
        for members in bins.values():
            assert sum(r["size"] for r in members) <= 2048
            sources = [source[r.doc_id] for r in members if source[r.doc_id] is not None]
            assert len(sources) == len(set(sources))


def test_stages_take_awkward_and_empty_tables(spark, data):
    for docs in (awkward.documents(spark, extra=False), awkward.empty(spark, awkward.documents(spark, extra=False))):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, data).count() >= 0, name
