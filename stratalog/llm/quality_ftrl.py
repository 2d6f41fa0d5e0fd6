"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal.

A document's features are its word n-grams and word-shape n-grams, hashed to ``2**bits``
slots; a feature's value is its count over the document's number of words.  Follow-the-
regularised-leader keeps two numbers a slot, z and n, and the weight of a slot follows from
them, exactly zero within the L1 bound.  A score is the sigmoid of the sparse dot product,
which is the mean over the words of the weights of their n-grams.

The model is fitted on a bounded sample of labelled rows (``Settings.max_train``: those with
the smallest hash of their id); every document is scored, over its whole text.

Defined cases: a null or empty text has no features and scores the sigmoid of the bias; a null
label is not learned from; repeated rows are each scored, and learned from once; without
labelled rows every score is 0.5; columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .store import fold


@dataclass(frozen=True)
class Settings:
    bits: int = 19
    word_orders: tuple[int, ...] = (1, 2)
    shape_orders: tuple[int, ...] = (1, 2)
    max_train: int = 6000  # bound of the labelled sample
    epochs: int = 4
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-3
    gain: float = 10.0  # scale of the feature values


def slots(b: words.Block, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: its slots, and the first word of each n-gram."""
    kinds = [(b.h, s.word_orders, 1)]
    if s.shape_orders:
        kinds.append((words.shape_hashes(b), s.shape_orders, 2))
    doc = np.repeat(np.arange(b.n), b.n_words)
    for h, orders, kind in kinds:
        for k in orders:
            n = len(h) - k + 1
            if n <= 0:
                continue
            x = np.full(n, kind * 1000 + k, dtype=np.uint64)
            for j in range(k):
                x = x * words.U(0x9FB21C651E98DF25) + h[j : j + n]
            at = np.flatnonzero(doc[:n] == doc[k - 1 :])
            yield (words.mix(x[at]) >> words.U(64 - s.bits)).astype(np.int64), at


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> np.ndarray:
    """Weights of the slots, and last of the bias, after ``epochs`` passes in the given order."""
    size = (1 << s.bits) + 1
    z, n, w = (np.zeros(size) for _ in range(3))
    for _ in range(s.epochs):
        for at, value, label in rows:
            p = 1 / (1 + np.exp(-np.clip(w[at] @ value, -35, 35)))
            g = (p - label) * value
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / s.alpha * w[at]
            n[at] = after
            zs = z[at]
            w[at] = np.where(np.abs(zs) <= s.l1, 0.0, -(zs - np.sign(zs) * s.l1) / ((s.beta + np.sqrt(after)) / s.alpha + s.l2))
    return w.astype(np.float32)


def training_rows(texts: list[bytes | None], labels: list[int], s: Settings) -> list[tuple[np.ndarray, np.ndarray, int]]:
    bias = 1 << s.bits
    out = []
    for b in words.blocks(texts):
        doc = np.repeat(np.arange(b.n), b.n_words)
        parts = [(doc[at], slot) for slot, at in slots(b, s)]
        d = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, dtype=np.int64)
        f = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, dtype=np.int64)
        key, count = np.unique((d << s.bits) | f, return_counts=True)
        cut = np.searchsorted(key, np.arange(b.n + 1) << s.bits)
        for i in range(b.n):
            part = slice(cut[i], cut[i + 1])
            at = np.append(key[part] & (bias - 1), bias)
            value = np.append(count[part] * (s.gain / max(1, b.n_words[i])), 1.0)
            out.append((at, value, labels[b.lo + i]))
    return out


def scores(texts: list[bytes | None], w: np.ndarray, s: Settings) -> np.ndarray:
    """Score of every text of a batch."""
    out = np.empty(len(texts))
    for b in words.blocks(texts):
        total = np.zeros(b.n)
        for slot, at in slots(b, s):
            total += words.segment_sums(w[slot], np.searchsorted(at, b.first))
        x = w[-1] + total * s.gain / np.maximum(1, b.n_words)
        out[b.lo : b.lo + b.n] = 1 / (1 + np.exp(-np.clip(x, -35, 35)))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, bound: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``bound`` labelled documents, one row an id: the rows of
    ``labels`` where ``keep`` holds that have the smallest hash of their id.  The bound on the
    labels is what makes the broadcast safe; documents are only filtered by it."""
    few = (
        labels.where(keep & F.col(label).isNotNull())
        .select("doc_id", F.col(label).cast("int").alias("label"))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, keep, s: Settings = Settings(), label: str = "quality") -> np.ndarray:
    """Weights learned from the rows of ``labels`` where the condition ``keep`` holds."""
    few = labelled_sample(docs, labels, label, keep, s.max_train)

    def fit(batches):
        import pyarrow as pa

        ids, texts, ys = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            ys += batch.column(1).to_pylist()
            texts += words.column_bytes(batch, "text")
        order = sorted(range(len(ids)), key=lambda i: (words.mix(np.array([ids[i] or 0]).astype(np.uint64))[0], ids[i] or 0))
        w = ftrl(training_rows([texts[i] for i in order], [ys[i] for i in order], s), s)
        yield pa.RecordBatch.from_pydict({"w": pa.array([w.tobytes()], pa.binary())})

    got = few.coalesce(1).mapInArrow(fit, "w binary").collect()
    return np.frombuffer(got[0].w, dtype=np.float32) if got else np.zeros((1 << s.bits) + 1, dtype=np.float32)


def score(docs: DataFrame, w: np.ndarray, s: Settings = Settings(), extra: tuple = ()) -> DataFrame:
    """``doc_id``, the ``extra`` columns and ``score`` of every document."""
    import pyarrow as pa

    spark = docs.sparkSession
    words.small_batches(spark)
    model = spark.sparkContext.broadcast(w)
    df = docs.select("doc_id", *extra, "text")
    schema = df.drop("text").schema.add("score", "double")

    def run(batches):
        for batch in batches:
            x = pa.array(scores(words.column_bytes(batch, "text"), model.value, s), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], x], names=[*batch.schema.names[:-1], "score"])

    return df.mapInArrow(run, schema)


def keep_at_least(docs: DataFrame, w: np.ndarray, threshold: float, s: Settings = Settings()) -> DataFrame:
    """The documents whose score reaches ``threshold``, with all their columns."""
    import pyarrow as pa

    spark = docs.sparkSession
    words.small_batches(spark)
    model = spark.sparkContext.broadcast(w)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(words.column_bytes(batch, "text"), model.value, s) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def learnable() -> Column:
    """The fold that labels may be learned from: crc32(doc_id as text) mod 5 is not 0."""
    return fold(5) != 0


def query(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    w = train(docs, labels, learnable(), s)
    return score(docs, w, s).select(
        "doc_id",
        F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
