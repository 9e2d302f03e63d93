"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word enters as a hashed word vector plus the mean of hashed vectors of its character 4-grams, so inflected forms share what
their stems teach. Windows of `width` words overlap by `width - stride`; a window's attention-pooled states give a logit, and a text's
score is that of its highest window. All windows of every text are scored.

Training: a bounded sample of labelled rows (TRAIN_ROWS toxic rows and three times as many others, in hash order, texts up to TRAIN_BYTES) is fitted on the driver. Texts
carry the label, so each epoch trains on the window of each text that scores highest at the time. Vectors start from smoothed log-odds of
their word or n-gram in the sample.

Defined cases: null and empty texts are one window without words and get the score of the output bias; equal texts get equal scores; rows
may repeat; a null id counts as empty text in the fold, so it is never held out, and never trains; without labels of both classes every score is 0; an empty
table gives an empty result; clashing columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, StructField, StructType

from strandline.llm.common import Words, byte_hash, pieces, utf8

TRAIN_ROWS, TRAIN_BYTES = 400, 40_000  # rows that carry the label; three times as many that don't
BUCKETS, DIM, HID, ATT = 1 << 14, 8, 6, 6
WIDTH, STRIDE = 64, 32  # a run of 33 words or fewer lies inside one window
THRESHOLD = 0.7
DECAY = 2e-5
STEPS = 100  # at least, however small the sample
_inner = np.zeros(256, bool)
_inner[list(b"0123456789abcdefghijklmnopqrstuvwxyz'")] = True
_inner[128:] = True


def sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Vocab:
    """Distinct words of a batch with their feature buckets; ids[i] is the row of word i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = Words(data, offsets, fold=True)
        data = w.data
        # punctuation around a word isn't part of it
        start, end = w.start.copy(), w.end.copy()
        for _ in range(3):
            go = (end - start > 1) & ~_inner[data[start]]
            start[go] += 1
            go = (end - start > 1) & ~_inner[data[end - 1]]
            end[go] -= 1
        h = byte_hash(data, start, end)
        distinct, index, self.ids = np.unique(h, return_index=True, return_inverse=True)
        self.first, n = w.first, len(distinct)
        self.word = (distinct % np.uint64(BUCKETS)).astype(np.int64)
        a, b = start[index], end[index]
        size = b - a
        flat_at = np.cumsum(size + 2) - (size + 2)
        flat = np.zeros(int((size + 2).sum()), np.uint8)  # 0 marks both ends
        if n:
            flat[np.repeat(flat_at + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())] = data[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        grams, owner = [], []
        of = np.repeat(np.arange(n), size + 2)
        for k in (4,):
            at = np.arange(max(len(flat) - k + 1, 0))
            at = at[of[at] == of[at + k - 1]] if len(at) else at
            grams.append((byte_hash(flat, at, at + k) % np.uint64(BUCKETS)).astype(np.int64))
            owner.append(of[at] if len(flat) else at)
        g, o = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(o, kind="stable")
        self.grams, self.gram_word = g[order], o[order]
        self.n_grams = np.bincount(self.gram_word, minlength=n)


def windows(first: np.ndarray, width: int = WIDTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of all windows; a text without words has one of length 0."""
    n = np.diff(first)
    count = 1 + np.maximum(0, -(-(n - width) // stride))
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = nth * stride
    return doc, first[doc] + start, np.minimum(width, n[doc] - start)


@dataclass
class Net:
    """Parameters; p holds arrays by name."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 7) -> Net:
        r = np.random.default_rng(seed)
        f = lambda *s, k=None: (r.standard_normal(s) / np.sqrt(k or s[0])).astype(np.float32)
        p = {"Ew": 0.1 * f(BUCKETS, DIM, k=1), "Ec": 0.1 * f(BUCKETS, DIM, k=1), "A": f(2 * HID, ATT), "v": f(ATT), "w": f(2 * HID), "b": np.zeros(1, np.float32)}
        for s in "fb":
            p[f"W{s}"], p[f"U{s}"], p[f"c{s}"] = f(DIM, 3 * HID), f(HID, 3 * HID), np.zeros(3 * HID, np.float32)
        return cls(p)

    def word_vectors(self, v: Vocab) -> np.ndarray:
        """One row for each distinct word, and a last row of zeros for padding."""
        out = np.zeros((len(v.word) + 1, DIM), np.float32)
        if len(v.word):
            starts = np.cumsum(v.n_grams) - v.n_grams
            some = v.n_grams > 0
            if some.any():
                out[:-1][some] = np.add.reduceat(self.p["Ec"][v.grams], starts[some]) / v.n_grams[some][:, None]
            out[:-1] += self.p["Ew"][v.word]
        return out

    def _gru(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States (t, n, HID) from projected inputs x (t, n, 3 HID); padding holds the state."""
        U = self.p[f"U{side}"]
        steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        h = np.zeros((x.shape[1], HID), np.float32)
        out = np.empty((*x.shape[:2], HID), np.float32)
        tape = []
        for t in steps:
            a = h @ U
            zr = sigmoid(x[t, :, : 2 * HID] + a[:, : 2 * HID])
            z, r = zr[:, :HID], zr[:, HID:]
            n = np.tanh(x[t, :, 2 * HID :] + r * a[:, 2 * HID :])
            m = mask[t][:, None]
            new = n + z * (h - n)
            new = h + m * (new - h)
            if keep:
                tape.append((t, h, z, r, n, a[:, 2 * HID :], m))
            h = new
            out[t] = h
        return out, tape

    def forward(self, vectors: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False, proj=None):
        """Logits of windows; index and mask are (t, n)."""
        p = self.p
        px = proj or {s: vectors @ p[f"W{s}"] + p[f"c{s}"] for s in "fb"}
        hf, tf = self._gru("f", px["f"][index], mask, keep)
        hb, tb = self._gru("b", px["b"][index], mask, keep)
        h = np.concatenate([hf, hb], 2)
        u = np.tanh(h @ p["A"])
        s = u @ p["v"] + (mask - 1) * 30
        s -= s.max(0)
        a = np.exp(s) * (mask + (mask.sum(0) == 0))
        a /= a.sum(0)
        ctx = (a[..., None] * h).sum(0)
        logit = ctx @ p["w"] + p["b"][0]
        return logit, (index, mask, tf, tb, h, u, a, ctx) if keep else None

    def backward(self, vectors: np.ndarray, saved, d_logit: np.ndarray):
        """Gradients of the dense parameters, and of the word vectors."""
        p = self.p
        index, mask, tf, tb, h, u, a, ctx = saved
        g = {"w": ctx.T @ d_logit, "b": np.array([d_logit.sum()], np.float32)}
        d_ctx = d_logit[:, None] * p["w"]
        d_a = (h * d_ctx).sum(2)
        d_s = a * (d_a - (a * d_a).sum(0))
        g["v"] = (u * d_s[..., None]).sum((0, 1))
        d_u = d_s[..., None] * p["v"] * (1 - u * u)
        g["A"] = np.tensordot(h, d_u, ((0, 1), (0, 1)))
        d_h = a[..., None] * d_ctx + d_u @ p["A"].T
        d_vec = np.zeros_like(vectors)
        for s, tape, part in (("f", tf, d_h[..., :HID]), ("b", tb, d_h[..., HID:])):
            U, W = p[f"U{s}"], p[f"W{s}"]
            gU, d_x = np.zeros_like(U), np.zeros((*index.shape, 3 * HID), np.float32)
            carry = np.zeros((index.shape[1], HID), np.float32)
            for t, prev, z, r, n, an, m in reversed(tape):
                d = part[t] + carry
                live = d * m
                dn = live * (1 - z) * (1 - n * n)
                dz = live * (prev - n) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                dx = np.concatenate([dz, dr, dn], 1)
                da = np.concatenate([dz, dr, dn * r], 1)
                d_x[t] = dx
                gU += prev.T @ da
                carry = d * (1 - m) + live * z + da @ U.T
            g[f"U{s}"] = gU
            flat_i, flat_d = index.ravel(), d_x.reshape(-1, 3 * HID)
            x = vectors[flat_i]
            g[f"W{s}"], g[f"c{s}"] = x.T @ flat_d, flat_d.sum(0)
            np.add.at(d_vec, flat_i, flat_d @ W.T)
        return g, d_vec

    def score_windows(self, v: Vocab, start: np.ndarray, length: np.ndarray, chunk: int = 512) -> np.ndarray:
        """Logits of windows, `chunk` of like lengths at a time; both directions step together."""
        p, side = self.p, ("f", "b")
        vectors = self.word_vectors(v)
        gate = lambda m, i: m[..., i * HID : (i + 1) * HID]
        proj = np.concatenate([gate(vectors @ p[f"W{s}"] + p[f"c{s}"], i) for i in range(3) for s in side], 1).astype(np.float32)
        zero = np.zeros((HID, HID), np.float32)
        U = np.block([[gate(p["Uf"], i) if s == "f" else zero for i in range(3) for s in side], [zero if s == "f" else gate(p["Ub"], i) for i in range(3) for s in side]]).astype(np.float32)
        proj[:, : 4 * HID] *= 0.5  # sigmoid(x) = (1 + np.tanh(x / 2)) / 2
        U[:, : 4 * HID] *= 0.5
        # rows of full width, so that a step adds one gathered row of each direction
        front, back = proj.copy(), proj.copy()
        for i in range(3):
            front[:, (2 * i + 1) * HID : (2 * i + 2) * HID] = 0
            back[:, 2 * i * HID : (2 * i + 1) * HID] = 0
        ids = np.append(v.ids, len(v.word))
        out = np.empty(len(start), np.float32)
        order = np.argsort(length, kind="stable")
        for i in range(0, len(start), chunk):
            o = order[i : i + chunk]
            index, mask = window_index(ids, start[o], length[o])
            full = bool(mask.all())
            steps, n = index.shape
            h = np.zeros((n, 2 * HID), np.float32)
            states = np.empty((steps, n, 2 * HID), np.float32)
            x, y = np.empty((n, 6 * HID), np.float32), np.empty((n, 6 * HID), np.float32)
            for t in range(steps):
                np.take(front, index[t], 0, out=x, mode="clip")
                np.take(back, index[steps - 1 - t], 0, out=y, mode="clip")
                x += y
                a = h @ U
                zr = x[:, : 4 * HID] + a[:, : 4 * HID]
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                c = a[:, 4 * HID :]
                c *= zr[:, 2 * HID :]
                c += x[:, 4 * HID :]
                c = np.tanh(c)
                new = h - c
                new *= zr[:, : 2 * HID]
                new += c
                if not full:
                    new[:, :HID] = np.where(mask[t][:, None] > 0, new[:, :HID], h[:, :HID])
                    new[:, HID:] = np.where(mask[steps - 1 - t][:, None] > 0, new[:, HID:], h[:, HID:])
                h = new
                states[t, :, :HID] = h[:, :HID]
                states[steps - 1 - t, :, HID:] = h[:, HID:]
            s = np.tanh(states.reshape(-1, 2 * HID) @ p["A"]) @ p["v"]
            s = s.reshape(steps, n) + (mask - 1) * 30
            s -= s.max(0)
            w = np.exp(s) * (mask + (mask.sum(0) == 0))
            val = (states.reshape(-1, 2 * HID) @ p["w"]).reshape(steps, n)
            out[o] = (w * val).sum(0) / w.sum(0) + p["b"][0]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of each text: its highest window."""
        n = len(offsets) - 1
        if not n:
            return np.zeros(0)
        v = Vocab(data, offsets)
        doc, start, length = windows(v.first)
        top = np.maximum.reduceat(self.score_windows(v, start, length), np.searchsorted(doc, np.arange(n)))
        return sigmoid(top.astype(np.float64))


def window_index(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(max(int(length.max(initial=0)), 1))[:, None]
    inside = t < length
    return ids[np.where(inside, start + t, len(ids) - 1)], inside.astype(np.float32)


def train(texts: list[str], labels: np.ndarray, epochs: int = 5, batch: int = 96, rate: float = 0.01, seed: int = 7) -> Net:
    """Fits a net to texts and 0/1 labels."""
    net, r = Net.new(seed), np.random.default_rng(seed)
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    v = Vocab(data, offsets)
    doc, start, length = windows(v.first)
    ids = np.append(v.ids, len(v.word))
    # smoothed log-odds of the share of texts of each class that hold a feature
    word_doc = np.repeat(np.arange(len(texts)), np.diff(v.first))
    gram_first = np.cumsum(v.n_grams) - v.n_grams
    size = v.n_grams[v.ids]
    g_at = np.repeat(gram_first[v.ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    for name, feature, owner in (("Ew", v.word[v.ids], word_doc), ("Ec", v.grams[g_at], np.repeat(word_doc, size))):
        seen = np.unique(owner * BUCKETS + feature)
        d, f = seen // BUCKETS, seen % BUCKETS
        pos, neg = np.bincount(f, labels[d], BUCKETS), np.bincount(f, 1 - labels[d], BUCKETS)
        lift = (1 - labels).sum() / max(labels.sum(), 1)
        odds = np.log((pos * lift + 4) / (neg + 4))
        net.p[name][:, 0] = np.where(pos + neg >= 6, np.clip(odds, -2, 3) / 2, 0)
    hint = net.word_vectors(v)[ids, 0]
    index, mask = window_index(ids, start, length)
    strength = np.where(mask > 0, hint[np.where(mask > 0, start + np.arange(len(mask))[:, None], len(hint) - 1)], -9).max(0)
    moment: dict[str, list[np.ndarray]] = {}
    firsts = np.searchsorted(doc, np.arange(len(texts)))
    step = 0
    epochs = max(epochs, -(-STEPS * batch // max(len(texts), 1)))
    for epoch in range(epochs):
        value = strength if epoch < 0.4 * epochs else net.score_windows(v, start, length)
        top = np.lexsort((value, doc))[np.append(firsts[1:], len(doc)) - 1]
        extra = r.integers(0, len(doc), len(texts) // 3)
        extra = extra[labels[doc[extra]] == 0]  # any window of a clean text is clean
        todo = r.permutation(np.concatenate([top, extra]))
        for i in range(0, len(todo), batch):
            o = todo[i : i + batch]
            step += 1
            used, local = np.unique(index[: max(int(length[o].max()), 1), o], return_inverse=True)
            sub = _subset(v, used)
            vectors = np.zeros((len(used), DIM), np.float32)
            real = used < len(v.word)
            vectors[real] = net.word_vectors(sub)[:-1]
            drop = (r.random(real.sum()) < 0.5).astype(np.float32)[:, None]  # words must be known by their parts, too
            vectors[real] -= drop * net.p["Ew"][sub.word]
            m = mask[: max(int(length[o].max()), 1), o]
            logit, saved = net.forward(vectors, local.reshape(m.shape), m, keep=True)
            y = labels[doc[o]]
            d = ((sigmoid(logit) - y) / len(o)).astype(np.float32)
            grads, d_vec = net.backward(vectors, saved, d)
            d_vec = d_vec[real]
            grads["Ew"] = (sub.word, d_vec * (1 - drop) + DECAY * net.p["Ew"][sub.word])
            grads["Ec"] = (sub.grams, (d_vec / np.maximum(sub.n_grams, 1)[:, None])[sub.gram_word] + DECAY / 4 * net.p["Ec"][sub.grams])
            lr = rate * min(1.0, step / 20) * (1 - 0.7 * epoch / epochs)
            for k, grad in grads.items():
                _adam(net.p[k], moment.setdefault(k, [np.zeros_like(net.p[k]), np.zeros_like(net.p[k])]), grad, lr, step)
    return net


def _subset(v: Vocab, used: np.ndarray) -> Vocab:
    used = used[used < len(v.word)]
    s = object.__new__(Vocab)
    first = np.cumsum(v.n_grams) - v.n_grams
    s.word, s.n_grams = v.word[used], v.n_grams[used]
    at = np.repeat(first[used] - (np.cumsum(s.n_grams) - s.n_grams), s.n_grams) + np.arange(s.n_grams.sum())
    s.grams, s.gram_word = v.grams[at], np.repeat(np.arange(len(used)), s.n_grams)
    return s


def _adam(p: np.ndarray, m: list[np.ndarray], grad, lr: float, step: int) -> None:
    rows = slice(None)
    if isinstance(grad, tuple):  # rows of a table
        rows, back = np.unique(grad[0], return_inverse=True)
        g = np.zeros((len(rows), p.shape[1]), np.float32)
        np.add.at(g, back, grad[1])
    else:
        g = np.clip(grad, -1, 1).astype(np.float32)
    m[0][rows] = 0.9 * m[0][rows] + 0.1 * g
    m[1][rows] = 0.99 * m[1][rows] + 0.01 * g * g
    p[rows] -= lr * (m[0][rows] / (1 - 0.9 ** min(step, 100))) / (np.sqrt(m[1][rows] / (1 - 0.99 ** min(step, 1000))) + 1e-6)


def fold_of(key: str):
    """crc32 of the id as text, mod 3; remainder 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def fitted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Net | None:
    """A net trained on at most `rows` toxic and 3 `rows` other labelled rows, none of them held out; None if a class is missing."""
    own = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold_of(key) != 1)).select(key, F.col(label).cast("int").alias("_y")).dropDuplicates([key])
    texts = docs.filter(F.col(text).isNotNull() & (F.octet_length(text) <= max_bytes) & (fold_of(key) != 1)).select(key, F.col(text).alias("_text"))
    order = F.xxhash64(F.lit(11), key)
    # ids first, so that only the sample's texts move
    chosen = own.filter("_y = 1").orderBy(order).limit(rows * 2).unionByName(own.filter("_y = 0").orderBy(order).limit(rows * 6))
    got = texts.join(F.broadcast(chosen), key).dropDuplicates([key]).select("_y", "_text", order.alias("o")).toPandas().sort_values("o")
    got = got[got.groupby("_y").cumcount() < np.where(got["_y"] == 1, rows, 3 * rows)]
    y = got["_y"].to_numpy().astype(np.float32)
    if not (y == 1).any() or not (y == 0).any():
        return None
    return train(got["_text"].tolist(), y)


def scored(docs: DataFrame, net: Net | None, text: str = "text", out: str = "_score") -> DataFrame:
    """docs with a score column; all other columns pass through."""
    if net is None:
        return docs.withColumn(out, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text, 1 << 21):
            s = shared.value.score(*utf8(b.column(text)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    net = fitted(docs, labels)
    out = scored(docs.select("doc_id", "text"), net).drop("text")
    return out.select("doc_id", (fold_of("doc_id") == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
