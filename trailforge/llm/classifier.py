"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes, each with the WIDTH - 1 bytes after it, so windows that begin in
a chunk are seen whole. A filter is a table of weights for every offset in the window and every byte; its outputs at
every STRIDE-th position, through a rectifier, are max-pooled by chunk. Windows begin at even bytes alone: every byte is in
three of them, but a text moved by one byte has other windows. Two is what the accuracy on held-out rows in the README was
reached with, at half the work of one; no row is known that a stride of one would save. The mean, maximum and spread of the
pooled values over all chunks go through one hidden layer into one probability. Repetition shows in the means and spreads
(few different windows have low maxima), symbols and case in the maxima.

Learned by Adam on log loss from a bounded sample of labelled rows: the first by hash of doc_id, none held out, at most `sample`
of them and no more after `size` bytes of text. A row is never left out for its own length: the one that reaches
`size` is the last. Training and scoring read whole texts. Without labels every score is 0.5.

Nulls are empty texts (one chunk of zero bytes); long texts are scored in slices of chunks; repeated rows have equal
scores; rows with a null doc_id are scored and not held out; an empty table gives an empty table. Only doc_id and text are
read from documents, doc_id and quality from labels.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, with_columns

CHUNK = 128
WIDTH = 6
STRIDE = 2
FILTERS = 16
HIDDEN = 16
#: Labelled rows that training sees at most, and the bytes of text after which it takes no more rows.
SAMPLE = 3000
SIZE = 64 << 20
#: Steps of training at least, for a sample of any size: twelve passes over SAMPLE rows.
STEPS = 1128
#: Bytes of text whose gradients are held at once; a longer text is alone.
AT_ONCE = 4 << 20
#: Chunks at a time.
SLICE = 512
CUT = 0.7


def chunks_of(text: str | None) -> np.ndarray:
    """A text's chunks as rows of CHUNK + WIDTH - 1 bytes, zeros after its end."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-len(raw) // CHUNK))
    padded = np.zeros(n * CHUNK + WIDTH - 1, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK + WIDTH - 1), (CHUNK, 1), writeable=False)


def convolve(rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Outputs (chunk, position, filter) of all filters, before the rectifier."""
    out = tables[0][rows[:, 0:CHUNK:STRIDE]]
    for w in range(1, WIDTH):
        out += tables[w][rows[:, w : w + CHUNK : STRIDE]]
    return out


def pooled(rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return np.concatenate([convolve(rows[k : k + SLICE], tables).max(axis=1) for k in range(0, len(rows), SLICE)])


def summary(m: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Mean, maximum and spread of rectified chunk values over each document's chunks, and what their gradients need."""
    n = np.diff(np.r_[starts, len(m)])[:, None]
    mean = np.add.reduceat(m, starts) / n
    top = np.maximum.reduceat(m, starts)
    spread = np.sqrt(np.maximum(np.add.reduceat(m * m, starts) / n - mean * mean, 0) + 1e-4)
    return mean, top, spread, n


class Network:
    """tables (offset, byte, filter), bias and the two dense layers."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        near = rng.normal(0, 1, (256, 6))  # bytes start as points, so that filters are smooth sums at first
        self.p = {
            "tables": np.einsum("bd,wdf->wbf", near, rng.normal(0, 0.25, (WIDTH, 6, FILTERS))).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "w1": rng.normal(0, 0.15, (3 * FILTERS, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }
        self.center = np.zeros(3 * FILTERS, np.float32)
        self.scale = np.ones(3 * FILTERS, np.float32)

    def head(self, m: np.ndarray, starts: np.ndarray):
        mean, top, spread, n = summary(m, starts)
        x = (np.concatenate([mean, top, spread], axis=1) - self.center) / self.scale
        h = np.tanh(x @ self.p["w1"] + self.p["b1"])
        return (mean, top, spread, n), x, h, h @ self.p["w2"] + self.p["b2"][0]

    def score(self, text: str | None) -> float:
        """Probability of label 1."""
        m = np.maximum(pooled(chunks_of(text), self.p["tables"]) + self.p["bias"], 0)
        return float(1 / (1 + np.exp(-np.float64(self.head(m, np.zeros(1, np.int64))[3][0]))))

    def gradients(self, rows: np.ndarray, starts: np.ndarray, y: np.ndarray, of: int | None = None) -> tuple[float, dict]:
        """Mean loss of documents and its gradients; as a share of a batch of `of` documents, where given."""
        p, g, batch = self.p, {}, of or len(y)
        raw, at = [], []
        for k in range(0, len(rows), SLICE):
            out = convolve(rows[k : k + SLICE], p["tables"])
            a = out.argmax(axis=1)
            at.append(a)
            raw.append(np.take_along_axis(out, a[:, None, :], 1)[:, 0])
        at, raw = np.concatenate(at), np.concatenate(raw) + p["bias"]
        m = np.maximum(raw, 0)
        (mean, top, spread, n), x, h, z = self.head(m, starts)
        q = 1 / (1 + np.exp(-z))
        loss = float(-np.sum(y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))) / batch
        dz = ((q - y) / batch).astype(np.float32)
        g["w2"], g["b2"] = (dz[:, None] * h).sum(axis=0), dz.sum(keepdims=True)
        dh = dz[:, None] * p["w2"] * (1 - h * h)
        g["w1"], g["b1"] = np.einsum("bi,bj->ij", x, dh), dh.sum(axis=0)
        dx = (dh @ p["w1"].T) / self.scale
        doc = np.repeat(np.arange(len(starts)), n[:, 0])
        d_mean, d_top, d_spread = dx[:, :FILTERS], dx[:, FILTERS : 2 * FILTERS], dx[:, 2 * FILTERS :]
        dm = (d_mean / n)[doc] + (d_spread / (spread * n))[doc] * (m - mean[doc])
        first = m == top[doc]
        dm += d_top[doc] * first / np.add.reduceat(first, starts)[doc]
        dm = np.where(raw > 0, dm, 0).astype(np.float32)
        g["bias"] = dm.sum(axis=0)
        g["tables"] = np.empty_like(p["tables"])
        chunk, filters = np.arange(len(rows))[:, None], np.arange(FILTERS)
        for w in range(WIDTH):
            key = rows[chunk, at * STRIDE + w].astype(np.int64) * FILTERS + filters
            g["tables"][w] = np.bincount(key.ravel(), dm.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        return loss, g


def _at_once(pick: np.ndarray, docs: list[np.ndarray]) -> list[np.ndarray]:
    """pick in parts of AT_ONCE bytes or one document."""
    sizes = np.cumsum([len(docs[i]) * CHUNK for i in pick])
    cuts = np.flatnonzero(np.diff(sizes // AT_ONCE)) + 1
    return np.split(pick, cuts)


def train(texts: list[str | None], labels: list[int], passes: int | None = None, batch: int = 32, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3) -> Network | None:
    """A network fitted to labels 0 and 1 in STEPS steps or more, if no number of passes is given; None without rows."""
    if not texts:
        return None
    passes = passes or -(-STEPS // -(-len(texts) // batch))
    net, rng = Network(seed), np.random.default_rng(seed)
    docs, y = [chunks_of(t) for t in texts], np.array(labels, np.float32)
    some = rng.permutation(len(docs))[:300]
    m = np.maximum(np.concatenate([pooled(docs[k], net.p["tables"]) for k in some]), 0)
    x = np.concatenate(summary(m, np.r_[0, np.cumsum([len(docs[k]) for k in some])[:-1]])[:3], axis=1)
    net.center, net.scale = x.mean(axis=0).astype(np.float32), (x.std(axis=0) + 1e-2).astype(np.float32)
    share = min(max(float(y.mean()), 0.01), 0.99)
    net.p["b2"][0] = np.log(share / (1 - share))
    one = {k: np.zeros_like(v) for k, v in net.p.items()}
    two = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, steps = 0, passes * -(-len(docs) // batch)
    for _ in range(passes):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            g = {}
            for part in _at_once(pick, docs):
                rows = np.concatenate([docs[i] for i in part])
                starts = np.r_[0, np.cumsum([len(docs[i]) for i in part])[:-1]]
                for name, d in net.gradients(rows, starts, y[part], len(pick))[1].items():
                    g[name] = g[name] + d if name in g else d
            step += 1
            now = rate * min(1.0, step / 50) * (1 - 0.9 * step / steps)
            for name, d in g.items():
                d = np.clip(d, -1, 1)
                one[name] += 0.1 * (d - one[name])
                two[name] += 0.001 * (d * d - two[name])
                move = one[name] / (1 - 0.9**step) / (np.sqrt(two[name] / (1 - 0.999**step)) + 1e-8)
                net.p[name] -= (now * (move + decay * net.p[name])).astype(np.float32)
    return net


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = SIZE) -> list[tuple[str, int]]:
    """(text, quality) of labelled documents, smallest hashes of doc_id first, none held out: sample rows at most, and no more
    once their texts have size bytes."""
    free = labels.where(F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    one = free.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    th = F.xxhash64("text")
    sizes = docs.select("doc_id", th.alias("th"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).join(F.broadcast(chosen), "doc_id")
    # how far the bounds reach is found without the texts
    so_far, taken = 0, []
    for row in sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(sample).collect():
        if so_far >= size:
            break
        so_far += row.bytes
        taken.append(row)
    if not taken:
        return []
    keys = docs.sparkSession.createDataFrame(sorted({(r.doc_id, r.th) for r in taken}), "doc_id long, th long")
    some = docs.select("doc_id", "text", th.alias("th")).join(F.broadcast(keys), ["doc_id", "th"])
    text = {(r.doc_id, r.th): r.text for r in some.groupBy("doc_id", "th").agg(F.any_value("text").alias("text")).collect()}  # equal rows once
    return [(text[r.doc_id, r.th], int(r.quality)) for r in taken]


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = training_rows(docs, labels, sample)
    net = train([t for t, _ in rows], [q for _, q in rows])

    def run(names, texts):
        scores = [0.5 if net is None else net.score(t) for t in texts.to_pylist()]
        return [list(map(held_out, names.to_pylist())), scores, [int(s >= cut) for s in scores]]

    return with_columns(docs.select("doc_id", "text"), run, ["doc_id", "text"], [field("held_out", "boolean"), field("score", "double"), field("predicted", "int")]).drop("text")
