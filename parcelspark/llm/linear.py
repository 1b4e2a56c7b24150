"""Hashed n-gram features and small linear models, trained on a bounded sample and applied in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parcelspark.llm.common import chunks, texts_of, windows, word_hashes

CHUNK = 1 << 18  # bytes of text at a time; the arrays of their n-grams take some 200 times that


@dataclass(frozen=True)
class Ngrams:
    """Which n-grams count: word n-grams and character n-grams (over UTF-8 bytes, 2 to 4 of them), hashed to 2**bits each."""

    words: tuple[int, ...] = (1, 2)
    chars: tuple[int, ...] = (3, 4)
    bits: int = 16
    power: float = 0.5  # a feature is its count over the number of n-grams to this power

    @property
    def size(self) -> int:
        return (bool(self.words) + bool(self.chars)) << self.bits

    def rows(self, docs: list[bytes]):
        """For word and for character n-grams: (feature of each n-gram, first n-gram of each text and the end)."""
        shift = np.uint64(64 - self.bits)
        if self.words:
            hashes, counts = word_hashes(docs)
            ends = np.cumsum(counts)
            parts, owner = [], []
            doc = np.repeat(np.arange(len(docs)), counts)
            for n in self.words:
                run = windows(hashes, n)
                inside = np.arange(len(run)) + n <= ends[doc[: len(run)]] if len(run) else np.zeros(0, bool)
                parts.append((run[inside] >> shift).astype(np.int32))
                owner.append(doc[: len(run)][inside])
            yield _by_text(parts, owner, len(docs), 0)
        if self.chars:
            buf = np.frombuffer(b"\n".join(docs) + b"\n\n\n\n", np.uint8)
            low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint32)
            sizes = np.array([len(d) + 1 for d in docs])
            starts = np.concatenate(([0], np.cumsum(sizes)))
            m = int(starts[-1])
            doc = np.repeat(np.arange(len(docs)), sizes)
            parts, owner = [], []
            for n in self.chars:
                code = np.zeros(m, np.uint32)
                for j in range(n):
                    code = code * np.uint32(256) + low[j : j + m]
                h = ((code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x27D4EB2F)
                inside = np.arange(m) + n <= starts[doc + 1]  # the line end that closes a text takes part
                parts.append((h[inside] >> np.uint32(32 - self.bits)).astype(np.int32))
                owner.append(doc[inside])
            yield _by_text(parts, owner, len(docs), (1 << self.bits) if self.words else 0)

    def sparse(self, docs: list[bytes]):
        """(indices, values) of each text: counts over a power of the number of n-grams, family by family."""
        index, count, number = {}, {}, {}
        for owner, parts in windows_of(docs):
            for f, (feature, edges) in enumerate(self.rows(parts)):
                for k, i in enumerate(owner):
                    ids, n = np.unique(feature[edges[k] : edges[k + 1]], return_counts=True)
                    if (i, f) in index:
                        ids, where = np.unique(np.concatenate((index[i, f], ids)), return_inverse=True)
                        n = np.bincount(where, np.concatenate((count[i, f], n)))
                    index[i, f], count[i, f], number[i, f] = ids, n, number.get((i, f), 0) + edges[k + 1] - edges[k]
        families = range(bool(self.words) + bool(self.chars))
        for i in range(len(docs)):
            yield np.concatenate([index[i, f] for f in families]), np.concatenate([count[i, f] / max(1, number[i, f]) ** self.power for f in families]).astype(np.float32)

    def project(self, docs: list[bytes], weights: np.ndarray) -> np.ndarray:
        """features @ weights, without building the features; weights is (size, models)."""
        families = bool(self.words) + bool(self.chars)
        sums, number = np.zeros((families, len(docs), weights.shape[1])), np.zeros((families, len(docs)))
        for owner, parts in windows_of(docs):
            for f, (feature, edges) in enumerate(self.rows(parts)):
                np.add.at(number[f], owner, np.diff(edges))
                for k in range(weights.shape[1]):
                    run = np.concatenate(([0.0], np.cumsum(weights[feature, k], dtype=np.float64)))
                    np.add.at(sums[f, :, k], owner, run[edges[1:]] - run[edges[:-1]])
        return (sums / (np.maximum(1, number) ** self.power)[:, :, None]).sum(0)


def windows_of(docs: list[bytes], most: int = CHUNK):
    """(numbers of the texts, windows) some ``most`` bytes at a time. Longer texts are cut between words where they can be; no n-gram spans a cut."""
    owner, parts, held = [], [], 0
    for i, d in enumerate(docs):
        at = 0
        while at == 0 or at < len(d):
            end = at + most
            if end < len(d):
                end = max(d.rfind(b" ", at + most // 2, end), d.rfind(b"\n", at + most // 2, end)) + 1 or end
            owner.append(i)
            parts.append(d[at:end])
            held += min(end, len(d)) - at
            if held >= most:
                yield owner, parts
                owner, parts, held = [], [], 0
            at = end
    if parts:
        yield owner, parts


def _by_text(parts, owner, n, base):
    feature, doc = np.concatenate(parts), np.concatenate(owner)
    if len(parts) > 1:
        order = np.argsort(doc, kind="stable")
        feature, doc = feature[order], doc[order]
    return feature + np.int32(base), np.searchsorted(doc, np.arange(n + 1))


def collect_features(sample: DataFrame, grams: Ngrams, label: str):
    """Features and labels of a bounded sample (columns doc_id, text and ``label``), by doc_id: sparse rows on the driver."""

    def run(batches):
        for b in batches:
            docs = texts_of(b.column(1))
            for i, j in chunks([len(d) for d in docs], CHUNK):
                rows = list(grams.sparse(docs[i:j]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array([x.astype("<u4").tobytes() for x, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())], ["doc_id", "label", "index", "value"])

    kind = sample.schema[label].dataType.simpleString()
    t = sample.select("doc_id", "text", label).mapInArrow(run, f"doc_id long, label {kind}, index binary, value binary").toArrow().sort_by("doc_id")
    index = [np.frombuffer(x, "<u4") for x in t.column("index").to_pylist()]
    value = [np.frombuffer(x, "<f4") for x in t.column("value").to_pylist()]
    labels = t.column("label").to_pylist()
    return index, value, np.array(labels)


class Rows:
    """Sparse rows with the two products that training needs."""

    def __init__(self, index, value, size):
        n = np.array([len(x) for x in index])
        self.index = np.concatenate(index).astype(np.int32) if len(index) else np.zeros(0, np.int32)
        self.value = np.concatenate(value).astype(np.float32) if len(value) else np.zeros(0, np.float32)
        self.row, self.count, self.size = np.repeat(np.arange(len(n), dtype=np.int32), n), len(n), size

    def dot(self, w):
        return np.bincount(self.row, weights=self.value * w[self.index], minlength=self.count)

    def back(self, g):
        return np.bincount(self.index, weights=self.value * g[self.row], minlength=self.size)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: Rows, y: np.ndarray, loss: str, l2: float = 1e-4, steps: int = 80, rate: float = 0.5):
    """Linear model for labels 0/1 with class-balanced weight: loss ``logistic`` or ``hinge`` (squared, a linear SVM). Full-batch Adam."""
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w, b = np.zeros(rows.size), 0.0
    m, v, mb, vb = np.zeros(rows.size), np.zeros(rows.size), 0.0, 0.0
    for t in range(1, steps + 1):
        z = sign * (rows.dot(w) + b)
        g = -sign * share * (sigmoid(-z) if loss == "logistic" else 2 * np.maximum(0, 1 - z))
        gw, gb = rows.back(g) + l2 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) / np.sqrt(t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def calibrate(score: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Platt scaling: (a, c) of sigmoid(a s + c), a >= 0, by Newton steps with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    centre, scale = (score.mean(), score.std() + 1e-9) if len(score) else (0.0, 1.0)
    x = np.stack([(score - centre) / scale, np.ones(len(score))], 1)
    beta = np.zeros(2)
    for _ in range(steps):
        p = sigmoid(x @ beta)
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, x.T @ (target - p) - 1e-3 * beta)
        beta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    a = max(0.0, beta[0]) / scale
    return float(a), float(beta[1] - a * centre)
