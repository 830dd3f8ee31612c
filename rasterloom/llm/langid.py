"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments of SEGMENT bytes; both directions run over each segment, every position gets a
softmax over the languages, and a document's probabilities are the mean over its positions. The network is trained
in numpy by backpropagation through time (Adam) on a bounded sample of labelled segments: at most BUCKETS for a
language, one from a hashed place of the document with the smallest hash of each bucket.

Cases: null text or text without a letter is `und` with score 0; without any labelled row all are; a null label is
not learned from; equal texts get equal answers; very long texts are many segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, kept_type, packed, parts, read, unpacked
from .pretoken import LETTER, classes

SEGMENT = 256
BUCKETS = 512


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiGRU:
    """Gate inputs are read from a table by byte, which stands for an embedding and its input weights together."""

    def __init__(self, labels: int, hidden: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        self.h = hidden
        self.p = {"xf": f(257, 3 * hidden), "xb": f(257, 3 * hidden), "uf": f(hidden, 3 * hidden), "ub": f(hidden, 3 * hidden), "v": f(2 * hidden, labels), "c": np.zeros(labels, np.float32)}

    def states(self, bytes_: np.ndarray, side: str, keep: list) -> np.ndarray:
        """[T, N, h] states over bytes_ [T, N], in the order given; keep gets what the gradients need."""
        x, u, h = self.p["x" + side], self.p["u" + side], self.h
        t_max, n = bytes_.shape
        s = np.zeros((n, h), np.float32)
        out = np.empty((t_max, n, h), np.float32)
        for t in range(t_max):
            gx = x[bytes_[t]]
            gu = s @ u
            zr = _sigmoid(gx[:, : 2 * h] + gu[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            cand = np.tanh(gx[:, 2 * h :] + r * gu[:, 2 * h :])
            keep.append((s, z, r, cand, gu[:, 2 * h :]))
            s = cand + z * (s - cand)
            out[t] = s
        return out

    def _logits(self, bytes_: np.ndarray, side: str, add: np.ndarray) -> None:
        """Add one direction's part of the logits to add [T, labels, N]; gates by rows, computed in place."""
        h, n = self.h, bytes_.shape[1]
        x, ut = self.p["x" + side].astype(np.float32), self.p["u" + side].T.astype(np.float32).copy()
        x[:, : 2 * h] *= 0.5  # sigmoid(v) = (1 + tanh(v / 2)) / 2
        ut[: 2 * h] *= 0.5
        v = np.ascontiguousarray(self.p["v"][:h] if side == "f" else self.p["v"][h:], np.float32).T.copy()
        s, gu, gx, d = np.zeros((h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((h, n), np.float32)
        zr, cand, y = gx[: 2 * h], gx[2 * h :], np.empty(add.shape[1:], np.float32)
        for t in range(len(bytes_)) if side == "f" else range(len(bytes_) - 1, -1, -1):
            gx[:] = x[bytes_[t]].T
            np.matmul(ut, s, gu)
            zr += gu[: 2 * h]
            np.tanh(zr, zr)
            zr += 1
            zr *= 0.5
            np.multiply(zr[h:], gu[2 * h :], d)
            cand += d
            np.tanh(cand, cand)
            np.subtract(s, cand, d)
            d *= zr[:h]
            np.add(cand, d, s)
            add[t] += np.matmul(v, s, y)

    def probabilities(self, bytes_: np.ndarray) -> np.ndarray:
        """[T, N, labels] for segments [T, N]."""
        y = np.empty((len(bytes_), len(self.p["c"]), bytes_.shape[1]), np.float32)
        y[:] = self.p["c"][:, None]
        self._logits(bytes_, "f", y)
        self._logits(bytes_, "b", y)
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y.transpose(0, 2, 1)

    def gradients(self, bytes_: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy over all positions."""
        kf, kb = [], []
        sf = self.states(bytes_, "f", kf)
        sb = self.states(bytes_[::-1], "b", kb)
        both = np.concatenate((sf, sb[::-1]), 2)
        y = both @ self.p["v"] + self.p["c"]
        y = np.exp(y - y.max(2, keepdims=True))
        y /= y.sum(2, keepdims=True)
        y[:, np.arange(len(label)), label] -= 1
        y *= (weight / (weight.sum() * len(bytes_)))[None, :, None].astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["v"] = np.tensordot(both, y, ((0, 1), (0, 1)))
        g["c"] = y.sum((0, 1))
        back = y @ self.p["v"].T
        h = self.h
        for side, held, order, d_out in (("f", kf, bytes_, back[:, :, :h]), ("b", kb, bytes_[::-1], back[::-1, :, h:])):
            u, ds = self.p["u" + side], np.zeros_like(held[0][0])
            for t in range(len(order) - 1, -1, -1):
                s, z, r, cand, gn = held[t]
                ds = ds + d_out[t]
                d_cand = ds * (1 - z) * (1 - cand * cand)
                dz = ds * (s - cand) * z * (1 - z)
                dr = d_cand * gn * r * (1 - r)
                dx = np.concatenate((dz, dr, d_cand), 1)
                du = np.concatenate((dz, dr, d_cand * r), 1)
                g["u" + side] += s.T @ du
                np.add.at(g["x" + side], order[t], dx)
                ds = ds * z + du @ u.T
        return g

    def train(self, bytes_: np.ndarray, label: np.ndarray, weight: np.ndarray, *, steps: int = 240, batch: int = 128, length: int = 64, rate: float = 0.02, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, steps + 1):
            rows = r.integers(0, bytes_.shape[1], batch)
            a = int(r.integers(0, max(1, bytes_.shape[0] - length + 1)))
            g = self.gradients(bytes_[a : a + length, rows], label[rows], weight[rows])
            lr = rate * (1 - i / (steps + 1)) + 1e-4
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k in self.p:
                x = g[k] * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v2[k] = 0.99 * v2[k] + 0.01 * x * x
                self.p[k] -= lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v2[k] / (1 - 0.99**i)) + 1e-8)


def _matrix(segments: list[bytes], length: int) -> np.ndarray:
    out = np.full((len(segments), length), 256, np.int16)
    for i, s in enumerate(segments):
        out[i, : len(s)] = np.frombuffer(s, np.uint8)
    return np.ascontiguousarray(out.T)


def fit(labelled: DataFrame) -> tuple[list[str], BiGRU | None]:
    """Learn from rows (doc_id, lang, text) that have a label and a text."""
    n = F.char_length("text")
    place = F.xxhash64("doc_id")
    seg = F.encode(F.substring(F.col("text"), F.pmod(place, F.greatest(F.lit(1), n - 96)).cast("int") + 1, F.lit(128)), "UTF-8")
    rows = labelled.where("lang is not null and length(text) > 0").select("lang", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(BUCKETS)).alias("b"), F.struct(F.xxhash64(F.lit(2), "doc_id").alias("h"), seg.alias("s")).alias("x"))
    got = rows.groupBy("lang", "b").agg(F.min("x").alias("x")).orderBy("lang", "b").toPandas()
    names = sorted(set(got["lang"]))
    if not names:
        return [], None
    label = np.asarray([names.index(x) for x in got["lang"]])
    weight = (1 / np.bincount(label))[label]
    net = BiGRU(len(names))
    if len(names) > 1:
        net.train(_matrix([bytes(x["s"])[:128] for x in got["x"]], 128), label, weight)
    return names, net


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    low = data | 32
    ascii_ = np.diff(np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))[off]) > 0
    for i in np.flatnonzero(~ascii_ & (np.diff(off) > 0)):
        cp = np.frombuffer(data[off[i] : off[i + 1]].tobytes().decode().encode("utf-32-le"), np.uint32)
        ascii_[i] = (classes()[cp] == LETTER).any()
    return ascii_


def pooled(net: BiGRU, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean label probabilities over the positions of each text."""
    sizes = np.diff(off)
    n_seg = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), n_seg)
    first = np.concatenate(([0], np.cumsum(n_seg)))
    start = off[doc] + (np.arange(len(doc)) - first[doc]) * SEGMENT
    length = np.minimum(off[doc + 1] - start, SEGMENT)
    labels = len(net.p["c"])
    total = np.zeros((len(sizes), labels))
    order = np.argsort(length, kind="stable")
    for a in range(0, len(order), 1024):
        rows = order[a : a + 1024]
        # the shortest of a block sets no padding for the rest beyond the longest
        t = int(length[rows].max())
        index = start[rows][None, :] + np.arange(t)[:, None]
        real = np.arange(t)[:, None] < length[rows][None, :]
        b = np.where(real, data[np.minimum(index, len(data) - 1)], 256).astype(np.int16)
        p = net.probabilities(b).transpose(0, 2, 1)
        p *= real[:, None]
        np.add.at(total, doc[rows], p.sum(0, dtype=float).T)
    return total / np.maximum(sizes, 1)[:, None]


def predict(docs: DataFrame, names: list[str], net: BiGRU | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns (but for those named like a result), lang_pred, score for every row of docs."""
    results = ["lang_pred", "score"]
    base = packed(docs, keep, text)

    def run(batches):
        for batch in batches:
            for a, b, data, off in parts(batch.column(1)):
                known = has_letter(data, off) & (net is not None)
                p = pooled(net, data, off) if net is not None else np.zeros((b - a, 1))
                best = p.argmax(1)
                pred = [names[j] if k else "und" for j, k in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, np.clip(p.max(1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pred, pa.string()), pa.array(score)], names=[KEPT, *results])

    return unpacked(base.mapInArrow(run, f"{kept_type(base)}, lang_pred string, score double"), keep, results)


def crc_rest(key: str, m: int):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % m, F.lit(-1))


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    names, net = fit(docs.where(crc_rest("doc_id", 4) != 2))
    return predict(docs, names, net).select("doc_id", (crc_rest("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
