"""Quality: a byte-level convolutional network in numpy.

Filters of WIDTH bytes run over the whole text; their responses are max-pooled in overlapping chunks of
two blocks, a hidden layer reads each chunk, and maximum and mean over all chunks make one
probability. A filter on one-hot bytes is a table per offset, so a response is a sum of look-ups; for
scoring, the tables of two neighbouring offsets are joined into one by byte pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches, table
from .toxicity import _logistic, sample_labelled

WIDTH = 4
BLOCK = 64
FILTERS = 24
HIDDEN = 16
PIECE = 1 << 13  # blocks looked up at once


def blocks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid from a block's start, padded with zeros, with an empty block after each; and blocks per text without that."""
    n = np.array([max(2, -(-len(t) // BLOCK)) for t in texts])
    at = np.concatenate(([0], np.cumsum(n + 1)))
    flat = np.zeros(at[-1] * BLOCK + WIDTH, np.uint8)
    for t, k in zip(texts, at.tolist(), strict=False):
        flat[k * BLOCK : k * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
    return flat, n


class Network:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.w = r.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32)
        self.wb = np.full(HIDDEN, 0.1, np.float32)
        self.out = r.normal(0, 0.1, 2 * HIDDEN).astype(np.float32)
        self.ob = np.zeros(1, np.float32)
        self.top = np.concatenate(([0.0], np.zeros(2 * HIDDEN)))
        self._pairs = None

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def chunks(self, flat: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each block."""
        if self._pairs is None:
            t = self.table
            self._pairs = tuple((t[k][None, :, :] + t[k + 1][:, None, :]).reshape(65536, FILTERS) for k in (0, 2))
        a, b = self._pairs
        pair = flat[:-1].astype(np.uint16) | (flat[1:].astype(np.uint16) << 8)
        blocks = (len(flat) - WIDTH) // BLOCK
        out = np.empty((blocks, FILTERS), np.float32)
        step = 256
        x, y = np.empty((step * BLOCK, FILTERS), np.float32), np.empty((step * BLOCK, FILTERS), np.float32)
        for at in range(0, blocks, step):
            n = min(step, blocks - at) * BLOCK
            k = at * BLOCK
            a.take(pair[k : k + n], axis=0, out=x[:n], mode="clip")
            b.take(pair[k + 2 : k + 2 + n], axis=0, out=y[:n], mode="clip")
            x[:n] += y[:n]
            x[:n].reshape(-1, BLOCK, FILTERS).max(axis=1, out=out[at : at + n // BLOCK])
        return out

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Maximum and mean over all chunks of each text's hidden layer."""
        out = np.empty((len(texts), 2 * HIDDEN))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < PIECE * BLOCK):
                size += len(texts[end])
                end += 1
            flat, n = blocks_of(texts[at:end])
            u = self.chunks(flat)
            u = np.maximum(np.maximum(u[:-1], u[1:]) + self.bias, 0)
            h = np.maximum(u @ self.w + self.wb, 0)
            first = np.concatenate(([0], np.cumsum(n + 1)[:-1]))
            edges = np.stack([first, first + n - 1], axis=1).ravel()  # chunks of a text: one fewer than its blocks
            out[at:end, :HIDDEN] = np.maximum.reduceat(h, edges, axis=0)[::2]
            out[at:end, HIDDEN:] = np.add.reduceat(h, edges, axis=0)[::2] / (n - 1)[:, None]
            at = end
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = self.top[0] + self.features(texts) @ self.top[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list]:
        """Loss and gradients for windows ``x`` of whole blocks (plus WIDTH - 1 bytes)."""
        n, blocks = len(x), (x.shape[1] - WIDTH + 1) // BLOCK
        length = blocks * BLOCK
        v = sum(self.table[k][x[:, k : k + length]] for k in range(WIDTH)).reshape(n, blocks, BLOCK, FILTERS)
        arg = v.argmax(axis=2)
        top = np.take_along_axis(v, arg[:, :, None, :], axis=2)[:, :, 0, :]
        pick = top[:, 1:] > top[:, :-1]
        u0 = np.maximum(top[:, 1:], top[:, :-1]) + self.bias
        u = np.maximum(u0, 0)
        h0 = u @ self.w + self.wb
        h = np.maximum(h0, 0)
        best = h.argmax(axis=1)
        f = np.concatenate([np.take_along_axis(h, best[:, None, :], axis=1)[:, 0, :], h.mean(axis=1)], axis=1)
        p = 1 / (1 + np.exp(-np.clip(f @ self.out + self.ob, -30, 30)))
        d = ((p - y) * weight / n).astype(np.float32)
        df = d[:, None] * self.out
        dh = np.repeat(df[:, None, HIDDEN:] / h.shape[1], h.shape[1], axis=1)
        np.put_along_axis(dh, best[:, None, :], np.take_along_axis(dh, best[:, None, :], axis=1) + df[:, None, :HIDDEN], axis=1)
        dh *= h0 > 0
        du = (dh @ self.w.T) * (u0 > 0)
        block = np.arange(blocks - 1)[None, :, None] + pick
        pos = block * BLOCK + np.take_along_axis(arg, block, axis=1)
        row, fil = np.arange(n)[:, None, None], np.arange(FILTERS)[None, None, :]
        dt = np.stack([np.bincount((x[row, pos + k].astype(np.int64) * FILTERS + fil).ravel(), du.ravel(), 256 * FILTERS).reshape(256, FILTERS) for k in range(WIDTH)])
        loss = -float(np.mean(weight * np.log(np.where(y == 1, p, 1 - p) + 1e-9)))
        return loss, [dt, du.sum(axis=(0, 1)), np.einsum("ncf,nch->fh", u, dh), dh.sum(axis=(0, 1)), d @ f, np.array([d.sum()])]


def train(texts: list[bytes], labels: list[int], epochs: int = 6, window: int = 24, batch: int = 32, seed: int = 0) -> Network:
    """Adam on a random window of ``window`` blocks of each text; then the last layer is refitted on whole texts."""
    net, r, y = Network(seed), np.random.default_rng(seed), np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.top[0] = 0.0 if not labels else 4.0 * (2 * labels[0] - 1)
        return net
    share = float(y.mean())
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    params = [net.table, net.bias, net.w, net.wb, net.out, net.ob]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    size = window * BLOCK
    for epoch in range(epochs):
        order = r.permutation(len(y))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x = np.zeros((len(part), size + WIDTH - 1), np.uint8)
            for row, i in zip(x, part, strict=True):
                k = int(r.integers(0, max(1, len(texts[i]) - size)))
                b = np.frombuffer(texts[i][k : k + size + WIDTH - 1], np.uint8)
                row[: len(b)] = b
            used = max(2, -(-min(size, max(len(texts[i]) for i in part)) // BLOCK))
            _, grads = net.step(x[:, : used * BLOCK + WIDTH - 1], y[part], weight[part])
            t += 1
            rate = 0.01 * 0.5 ** (epoch / 2)
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    f = net.features(texts)
    net.top = _logistic(np.concatenate([np.ones((len(f), 1)), f], axis=1), y.astype(np.float64), np.ones(len(y)), ridge=0.1)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> Network:
    """Network from at most ``sample`` labelled documents outside the held-out fold."""
    rows = sample_labelled(docs, labels, "quality", sample=sample)
    return train([(t or "").encode() for t, _ in rows], [y for _, y in rows])


def quality_scores(docs: DataFrame, net: Network, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, score`` of every row's whole text; null counts as empty, and an empty text has a score like any other."""
    small_batches(docs.sparkSession)
    box = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                s = box.value.score([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scores = quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
