"""A linear reading of averaged, hashed subword embeddings, trained by stochastic gradient descent in numpy.

A document is the mean of the vectors of its features: hashed words, pairs of neighbouring
words, and character n-grams. A softmax layer turns the mean into class probabilities. As both
steps are linear, a trained model folds into one number per bucket, so that scoring a
document is a mean of table entries.
"""

from __future__ import annotations

import numpy as np

from .common import LOWER, NOT_SPACE, mix, span_hashes, words

#: Buckets of the hashed features; a word, pair or n-gram falls into one by its hash.
BUCKETS = 1 << 16
N_GRAMS = (3, 5)


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the texts, and the text of each."""
    starts, ends, doc = words(raw, off, NOT_SPACE)
    h = span_hashes(LOWER[raw] if len(raw) else raw, starts, ends)
    out, of = [h], [doc]
    if len(h) > 1:
        pair = np.where(h[1:] == h[:-1], np.uint64(12345), mix(h[1:] * np.uint64(3) + h[:-1]))
        same = doc[1:] == doc[:-1]
        out.append(pair[same])
        of.append(doc[1:][same])
    if len(raw):
        b = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
        where = np.searchsorted(at, np.arange(len(b)), "right") - 1
        for n in N_GRAMS:
            if len(b) < n:
                continue
            g = np.zeros(len(b) - n + 1, np.uint32)
            for i in range(n):
                g = g * np.uint32(0x01000193) + b[i : len(b) - n + 1 + i] + np.uint32(n)
            g = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            g ^= g >> np.uint32(13)
            inside = where[n - 1 :] == where[: len(b) - n + 1]
            out.append(g[inside].astype(np.uint64))
            of.append(where[: len(b) - n + 1][inside])
    return (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int32), np.concatenate(of)


def bags(raw: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, its distinct buckets and their shares."""
    f, of = features(raw, off)
    n = len(off) - 1
    key, count = np.unique(of.astype(np.int64) * BUCKETS + f, return_counts=True)
    d, f = key // BUCKETS, (key % BUCKETS).astype(np.int32)
    total = np.maximum(np.bincount(d, weights=count, minlength=n), 1)
    share = (count / total[d]).astype(np.float32)
    cut = np.searchsorted(d, np.arange(n + 1))
    return [(f[cut[i] : cut[i + 1]], share[cut[i] : cut[i + 1]]) for i in range(n)]


def train(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, dim: int = 8, epochs: int = 8, batch: int = 32, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Embeddings and softmax layer by minibatch gradient descent (Adagrad steps); returns the folded table and bias.

    Score of a document: sigmoid(mean over its features of table[bucket] + bias).
    """
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / dim, (dim, BUCKETS)).astype(np.float32)
    layer = np.zeros((dim, 2), np.float32)
    layer[:, 1] = rng.normal(0, 1, dim)
    layer[:, 0] = -layer[:, 1]
    bias = np.zeros(2, np.float32)
    g_emb = np.full(BUCKETS, 1e-6, np.float32)
    g_layer, g_bias = np.full((dim, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            f = np.concatenate([docs[i][0] for i in pick])
            if not len(f):
                continue
            c = np.concatenate([docs[i][1] for i in pick])
            d = np.repeat(np.arange(len(pick)), [len(docs[i][0]) for i in pick])
            mean = np.stack([np.bincount(d, emb[k][f] * c, len(pick)) for k in range(dim)], 1)
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= weight[pick][:, None] / len(pick)
            back = p @ layer.T
            step = mean.T @ p
            g_layer += step**2
            layer -= rate * 0.2 * step / np.sqrt(g_layer)
            step = p.sum(0)
            g_bias += step**2
            bias -= rate * 0.2 * step / np.sqrt(g_bias)
            u, inv = np.unique(f, return_inverse=True)
            grad = np.stack([np.bincount(inv, back[d, k] * c, len(u)) for k in range(dim)])
            g_emb[u] += (grad**2).mean(0)
            emb[:, u] -= (rate * grad / np.sqrt(g_emb[u])).astype(np.float32)
    table = ((layer[:, 1] - layer[:, 0])[:, None] * emb).sum(0)
    return table.astype(np.float32), float(bias[1] - bias[0])


def scores(raw: np.ndarray, off: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    n = len(off) - 1
    f, of = features(raw, off)
    total = np.bincount(of, table[f], n)
    count = np.maximum(np.bincount(of, minlength=n), 1)
    return 1 / (1 + np.exp(-np.clip(total / count + bias, -30, 30)))
