"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs.  A word is the sum of an embedding of its folded, punctuation-free form (hashed to
``2**word_bits`` rows) and of those of its character n-grams (hashed to ``2**char_bits`` rows), taken
over the word with marks at its ends.

Network.  A gated recurrent unit reads a window of words forwards, another backwards; each word's
two states give an attention logit, the attention-weighted mean of the states gives the window's
logit.  A document's score is the sigmoid of its largest window logit.

Windows.  Every text is covered by overlapping windows of ``window`` words, ``stride`` apart, the
last one ending with the text, so each run of ``window - stride`` words lies whole in a window.
All windows of the whole text are scored.

Training.  By Adam on a bounded sample of labelled documents (``max_train``), in a fixed number of
steps: a step takes as many toxic as other documents, finds each one's strongest window under the
current weights (one of a few drawn windows early on), and follows the gradient of the logistic
loss through attention and time.  Embeddings begin at the log-odds of words and n-grams among toxic
documents, spread over the vector, which the network then refines.  It runs in one task; its
result is one row.

Defined cases: a null or empty text is one window of no words and scores the bias; a null label is
not learned from; repeated rows are each scored, and learned from once; without labelled rows of
both kinds every score is 0.5 or the bias; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .quality_ftrl import labelled_sample
from .store import fold

U = words.U
f32 = np.float32


@dataclass(frozen=True)
class Settings:
    word_bits: int = 16
    char_bits: int = 16
    grams: tuple[int, ...] = (4, 6)  # bytes of a character n-gram, marks included
    dim: int = 12
    hidden: int = 8
    window: int = 48
    stride: int = 36
    max_train: int = 3000  # bound of the labelled sample
    steps: int = 240
    batch: int = 64
    rate: float = 0.01
    seed: int = 5


#: Shapes of the weights besides the embeddings; d is forwards or backwards.
def _shapes(s: Settings) -> dict[str, tuple[int, ...]]:
    gates = {f"{n}{d}": x for d in "fb" for n, x in (("W", (s.dim, 3 * s.hidden)), ("U", (s.hidden, 3 * s.hidden)), ("c", (3 * s.hidden,)))}
    return gates | {"a": (2 * s.hidden,), "o": (2 * s.hidden,), "bias": (1,)}


def word_inputs(b: words.Block, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word slot of every word; slots of its character n-grams, and where each word's begin."""
    w = (b.h >> U(64 - s.word_bits)).astype(np.int64)
    size = b.ends - b.starts + 2  # with a mark at both ends
    first = np.append(0, np.cumsum(size))
    text = np.full(int(first[-1]), ord("_"), dtype=np.uint8)
    at = np.repeat(b.starts - first[:-1] - 1, size) + np.arange(len(text))
    inner = np.ones(len(text), dtype=bool)
    inner[first[:-1]] = inner[first[1:] - 1] = False
    text[inner] = b.buf[at[inner]]
    capital = (text >= 65) & (text <= 90)
    text[capital] += 32
    slots, owner = [], []
    for k in s.grams:
        grams = np.maximum(size - k + 1, 1)
        before = np.cumsum(grams) - grams
        start = np.repeat(first[:-1] - before, grams) + np.arange(int(grams.sum()))
        end = np.repeat(first[1:], grams)
        code = np.full(len(start), k, dtype=np.uint64)
        for j in range(k):
            byte = np.where(start + j < end, text[np.minimum(start + j, len(text) - 1)], 0)
            code = code * U(0x100000001B3) + byte.astype(np.uint64) + U(1)
        slots.append((words.mix(code) >> U(64 - s.char_bits)).astype(np.int64))
        owner.append(np.repeat(np.arange(len(size)), grams))
    word = np.concatenate(owner)
    order = np.argsort(word, kind="stable")
    return w, np.concatenate(slots)[order], np.append(0, np.cumsum(np.bincount(word, minlength=len(size))))


def put_together(w: np.ndarray, c: np.ndarray, first: np.ndarray, p: dict) -> np.ndarray:
    """Input vectors: a word's embedding, and its n-grams' sum over the root of their number."""
    return p["E_word"][w] + np.add.reduceat(p["E_char"][c], first[:-1], axis=0) / np.sqrt(np.diff(first))[:, None].astype(f32)


def embed(b: words.Block, p: dict, s: Settings) -> np.ndarray:
    """Input vectors of a block's words; each distinct word is put together once."""
    if not len(b.h):
        return np.zeros((0, s.dim), dtype=f32)
    _, first, back = np.unique(b.h, return_index=True, return_inverse=True)
    some = _Some(b, first)
    return put_together(*word_inputs(some, s), p)[back]


class _Some:
    """Some words of a block."""

    def __init__(self, b: words.Block, at: np.ndarray):
        self.h, self.starts, self.ends, self.buf = b.h[at], b.starts[at], b.ends[at], b.buf


def spans(n_words: int, s: Settings) -> list[tuple[int, int]]:
    """Windows over a text of so many words."""
    if n_words <= s.window:
        return [(0, n_words)]
    starts = list(range(0, n_words - s.window, s.stride)) + [n_words - s.window]
    return [(x, x + s.window) for x in starts]


def _all_spans(n_words: np.ndarray, first: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and length of every window of a block's documents."""
    more = np.maximum(n_words - s.window, 0)
    count = -(-more // s.stride) + 1
    doc = np.repeat(np.arange(len(n_words)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * s.stride, more[doc])
    return doc, first[:-1][doc] + start, np.minimum(n_words[doc], s.window)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return f32(0.5) * (np.tanh(f32(0.5) * x) + f32(1))


def _scan(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool, h_size: int):
    """States (T, B, H) of a gated recurrent unit over projected inputs (T, B, 3H); where the mask
    is 0 the state stays."""
    steps, batch = mask.shape
    h = np.zeros((batch, h_size), dtype=f32)
    states = np.empty((steps, batch, h_size), dtype=f32)
    saved = []
    for t in range(steps):
        zr = _sigmoid(x[t, :, : 2 * h_size] + h @ u[:, : 2 * h_size])
        z, r = zr[:, :h_size], zr[:, h_size:]
        rh = r * h
        n = np.tanh(x[t, :, 2 * h_size :] + rh @ u[:, 2 * h_size :])
        gate = (f32(1) - z) * mask[t][:, None]
        if keep:
            saved.append((h, z, r, n, gate))
        h = h + gate * (n - h)
        states[t] = h
    return states, saved


def forward(x: np.ndarray, length: np.ndarray, p: dict, s: Settings, keep: bool = False):
    """Logits of windows from their inputs (T, B, dim), padded at the end."""
    steps, batch, _ = x.shape
    mask = (np.arange(steps)[:, None] < length[None, :]).astype(f32)
    flat = x.reshape(-1, s.dim)
    runs = []
    for d, order in (("f", slice(None)), ("b", slice(None, None, -1))):
        projected = (flat @ p["W" + d] + p["c" + d]).reshape(steps, batch, -1)[order]
        states, saved = _scan(projected, mask[order], p["U" + d], keep, s.hidden)
        runs.append((states[order], saved))
    h = np.concatenate([runs[0][0], runs[1][0]], axis=2)
    e = np.where(mask > 0, h @ p["a"], f32(-1e9))
    e = np.exp(e - e.max(axis=0))
    att = e * mask / np.maximum((e * mask).sum(axis=0), f32(1e-9))
    pooled = (att[:, :, None] * h).sum(axis=0)
    logit = pooled @ p["o"] + p["bias"][0]
    return (logit, (x, mask, runs, h, att, pooled)) if keep else logit


def backward(d_logit: np.ndarray, kept, p: dict, s: Settings) -> tuple[dict, np.ndarray]:
    """Gradients of the weights, and of the inputs."""
    x, mask, runs, h, att, pooled = kept
    steps, batch, _ = x.shape
    n = s.hidden
    g = {"o": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], dtype=f32)}
    d_pooled = d_logit[:, None] * p["o"]
    d_att = (h * d_pooled).sum(axis=2)
    d_e = att * (d_att - (att * d_att).sum(axis=0))
    d_h = att[:, :, None] * d_pooled + d_e[:, :, None] * p["a"]
    g["a"] = np.tensordot(d_e, h, axes=([0, 1], [0, 1])).astype(f32)
    d_x = np.zeros_like(x)
    for i, (d, order) in enumerate((("f", slice(None)), ("b", slice(None, None, -1)))):
        u, w = p["U" + d], p["W" + d]
        own = d_h[:, :, i * n : (i + 1) * n][order]
        d_in = np.zeros((steps, batch, 3 * n), dtype=f32)
        g_u = np.zeros_like(u)
        back = np.zeros((batch, n), dtype=f32)
        for t in range(steps - 1, -1, -1):
            before, z, r, new, gate = runs[i][1][t]
            m = mask[order][t][:, None]
            back = back + own[t]
            d_new = back * gate * (f32(1) - new * new)
            d_z = -back * m * (new - before) * z * (f32(1) - z)
            d_rh = d_new @ u[:, 2 * n :].T
            d_r = d_rh * before * r * (f32(1) - r)
            d_in[t, :, :n], d_in[t, :, n : 2 * n], d_in[t, :, 2 * n :] = d_z, d_r, d_new
            g_u[:, : 2 * n] += before.T @ d_in[t, :, : 2 * n]
            g_u[:, 2 * n :] += (r * before).T @ d_new
            back = back * (f32(1) - gate) + d_rh * r + d_in[t, :, : 2 * n] @ u[:, : 2 * n].T
        d_in = d_in[order].reshape(-1, 3 * n)
        g["U" + d], g["c" + d] = g_u, d_in.sum(axis=0)
        g["W" + d] = x.reshape(-1, s.dim).T @ d_in
        d_x += (d_in @ w.T).reshape(x.shape)
    return g, d_x


def _batch_inputs(vectors: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(T, B, dim) of windows over rows of vectors."""
    steps = max(1, int(length.max()))
    at = np.minimum(start[None, :] + np.arange(steps)[:, None], max(len(vectors) - 1, 0))
    return vectors[at] if len(vectors) else np.zeros((steps, len(start), vectors.shape[1]), dtype=f32)


def block_logits(b: words.Block, p: dict, s: Settings, at_once: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word, length and logit of every window of a block."""
    doc, start, length = _all_spans(b.n_words, b.first, s)
    vectors = embed(b, p, s)
    out = np.empty(len(doc), dtype=f32)
    order = np.argsort(length, kind="stable")
    for lo in range(0, len(doc), at_once):
        own = order[lo : lo + at_once]
        out[own] = forward(_batch_inputs(vectors, start[own], length[own]), length[own], p, s)
    return doc, start, length, out


def scores(texts: list[bytes | None], p: dict, s: Settings) -> np.ndarray:
    """Score of every text of a batch."""
    out = np.empty(len(texts))
    for b in words.blocks(texts, strip=True, target=1 << 19):
        doc, _, _, logit = block_logits(b, p, s)
        best = np.full(b.n, -np.inf)
        np.maximum.at(best, doc, logit)
        out[b.lo : b.lo + b.n] = 1 / (1 + np.exp(-np.clip(best, -35, 35)))
    return out


def initial(s: Settings) -> dict:
    rng = np.random.default_rng(s.seed)
    p = {k: (rng.normal(size=x) * 0.3).astype(f32) if len(x) == 2 else np.zeros(x, dtype=f32) for k, x in _shapes(s).items()}
    p["o"] = (rng.normal(size=2 * s.hidden) * 0.3).astype(f32)
    p["E_word"] = (rng.normal(size=(1 << s.word_bits, s.dim)) * 0.02).astype(f32)
    p["E_char"] = (rng.normal(size=(1 << s.char_bits, s.dim)) * 0.02).astype(f32)
    return p


def _log_odds(slot: np.ndarray, doc: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Log-odds that a document with this slot is toxic, drawn towards 0 where few have it."""
    pair = np.unique(slot << 32 | doc)
    n = [np.bincount(pair[y[pair & 0xFFFFFFFF] == v] >> 32, minlength=size) for v in (0, 1)]
    odds = np.log((n[1] + 0.5) / (y.sum() + 1)) - np.log((n[0] + 0.5) / ((1 - y).sum() + 1))
    return odds * (n[0] + n[1]) / (n[0] + n[1] + 5)


def fit(texts: list[bytes | None], labels: list[int], s: Settings = Settings()) -> dict:
    """Weights trained on these texts, in this order."""
    rng = np.random.default_rng(s.seed)
    p = initial(s)
    blocks = list(words.blocks(texts, strip=True, target=1 << 62)) if texts else []
    if not blocks or len(set(labels)) < 2:
        return p
    (b,) = blocks
    y = np.array(labels)
    # Log-odds of words and of character n-grams among toxic documents, by their slots.
    doc = np.repeat(np.arange(b.n), b.n_words)
    distinct, first, back = np.unique(b.h, return_index=True, return_inverse=True)
    w, c, g_first = word_inputs(_Some(b, first), s)
    spread = rng.choice([-1, 1], s.dim)
    of_word = _log_odds(w[back], doc, y, 1 << s.word_bits)
    grams = np.diff(g_first)
    pair = np.unique(back.astype(np.int64) << 32 | doc)  # distinct word and document
    own, where = pair >> 32, pair & 0xFFFFFFFF
    n = grams[own]
    at = np.repeat(g_first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    of_gram = _log_odds(c[at], np.repeat(where, n), y, 1 << s.char_bits)
    p["E_word"] += (0.3 * of_word[:, None] * spread).astype(f32)
    p["E_char"] += (0.3 * of_gram[:, None] * spread).astype(f32)
    strength = of_word[w] + np.maximum.reduceat(of_gram[c], g_first[:-1])
    mean = segment_max(strength[back], b.first)
    moments: dict[str, list[np.ndarray]] = {}
    kinds = [np.flatnonzero(y == v) for v in (0, 1)]
    for step in range(1, s.steps + 1):
        docs = np.concatenate([rng.choice(k, s.batch // 2) for k in kinds])
        doc_w, start, length = [], [], []
        for i in docs:
            options = spans(int(b.n_words[i]), s)
            if step <= s.steps // 4:  # early on: the window around the word with the largest odds
                at = mean[i] - b.first[i] if b.n_words[i] else 0
                options = [w for w in options if w[0] <= at < w[1]] or options
            elif len(options) > 12:
                at = mean[i] - b.first[i]
                near = [w for w in options if w[0] <= at < w[1]]
                options = near + [options[k] for k in rng.choice(len(options), 10, replace=False)]
            for lo, hi in options:
                doc_w.append(i)
                start.append(b.first[i] + lo)
                length.append(hi - lo)
        doc_w, start, length = np.array(doc_w), np.array(start), np.array(length)
        chosen = np.concatenate([np.arange(x, x + n) for x, n in zip(start, length, strict=True)]) if len(start) else np.empty(0, dtype=np.int64)
        used, at = np.unique(chosen, return_inverse=True)
        some = _Some(b, used)
        w, c, g_first = word_inputs(some, s)
        if not len(used):
            continue
        vectors = put_together(w, c, g_first, p)
        first_of = np.append(0, np.cumsum(length))[:-1]
        place = np.zeros(len(start), dtype=np.int64)
        place[length > 0] = at[first_of[length > 0]]
        logit = forward(_batch_inputs(vectors, place, length), length, p, s)
        best = {}
        for k in np.argsort(logit, kind="stable"):
            best[doc_w[k]] = k
        own = np.array([best[i] for i in docs])
        steps = max(1, int(length[own].max()))
        rows = np.minimum(place[own][None, :] + np.arange(steps)[:, None], len(vectors) - 1)
        logit, kept = forward(vectors[rows], length[own], p, s, keep=True)
        d = (1 / (1 + np.exp(-logit)) - y[docs]).astype(f32) / f32(len(docs))
        g, d_x = backward(d, kept, p, s)
        d_rows = np.zeros_like(vectors)
        valid = kept[1] > 0
        np.add.at(d_rows, rows[valid], d_x[valid])
        touched, inv = np.unique(w, return_inverse=True)
        e_word = np.zeros((len(touched), s.dim), dtype=f32)
        np.add.at(e_word, inv, d_rows)
        per = np.repeat(d_rows / np.sqrt(np.diff(g_first))[:, None].astype(f32), np.diff(g_first), axis=0)
        t_char, inv = np.unique(c, return_inverse=True)
        e_char = np.zeros((len(t_char), s.dim), dtype=f32)
        np.add.at(e_char, inv, per)
        rate = s.rate * (1 - 0.9 * step / s.steps)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k, v in g.items():
            v = v / max(1.0, norm)
            m = moments.setdefault(k, [np.zeros_like(p[k]), np.zeros_like(p[k])])
            m[0] += 0.1 * (v - m[0])
            m[1] += 0.01 * (v * v - m[1])
            p[k] = (p[k] - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)).astype(f32)
        for k, at_rows, v in (("E_word", touched, e_word), ("E_char", t_char, e_char)):
            m = moments.setdefault(k, [np.zeros_like(p[k])])
            m[0][at_rows] += v * v
            p[k][at_rows] -= f32(rate * 2) * v / (np.sqrt(m[0][at_rows]) + f32(1e-7))
    return p


def segment_max(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index of the largest value of every segment; its start for an empty one."""
    out = first[:-1].copy()
    for i, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if z > a:
            out[i] = a + int(np.argmax(values[a:z]))
    return out


def _packed(p: dict) -> bytes:
    import io

    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def _unpacked(data: bytes) -> dict:
    import io

    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


def learnable() -> Column:
    """The fold that labels may be learned from: crc32(doc_id as text) mod 4 is not 2."""
    return fold(4) != 2


def train(docs: DataFrame, labels: DataFrame, keep: Column, s: Settings = Settings(), label: str = "toxic") -> dict:
    few = labelled_sample(docs, labels, label, keep, s.max_train)

    def run(batches):
        import pyarrow as pa

        rows = []
        for batch in batches:
            rows += zip(batch.column(0).to_pylist(), words.column_bytes(batch, "text"), batch.column(1).to_pylist(), strict=True)
        rows.sort(key=lambda r: r[0] or 0)
        yield pa.RecordBatch.from_pydict({"w": pa.array([_packed(fit([r[1] for r in rows], [r[2] for r in rows], s))], pa.binary())})

    got = few.coalesce(1).mapInArrow(run, "w binary").collect()
    return _unpacked(got[0].w) if got else initial(s)


def score(docs: DataFrame, p: dict, s: Settings = Settings()) -> DataFrame:
    """``doc_id, score`` of every document."""
    spark = docs.sparkSession
    words.small_batches(spark)
    model = spark.sparkContext.broadcast(_packed(p))

    def run(batches):
        import pyarrow as pa

        weights = _unpacked(model.value)
        for batch in batches:
            x = pa.array(scores(words.column_bytes(batch, "text"), weights, s), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def query(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    p = train(docs, labels, learnable(), s)
    return score(docs, p, s).select(
        "doc_id",
        F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
