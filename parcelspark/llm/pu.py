"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1 in the training folds; everything else it learns from is unlabelled web text, and labels 0 are never read. The share of positives
among unlabelled text, the class prior, is estimated from a first classifier on rows that it was not fitted to: the least ratio of unlabelled to positive
rows above a score, with a bound on the error of both shares (best bin estimation). The second classifier minimises the non-negative unbiased
risk, prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)), with logistic loss, so its sigmoid is the score.

Both samples are bounded: at most ``POSITIVES`` and ``UNLABELLED`` rows of least keyed hash. Features are hashed word and character n-grams and, of the whole text, the shares
in ``SHAPE``. Every whole text is scored, a window at a time where it is long. Null and empty texts have no features and get the score of a text without any; equal texts score
alike whatever their ids. Where positives or unlabelled rows are missing every score is 0.5. Null ids are scored and never learned from; of a repeated id the least text and
the least label are learned from. Clashing columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import chunks, fold, labelled_texts, sample_rows, texts_of, trim
from parcelspark.llm.linear import CHUNK, Ngrams, Rows, sigmoid, windows_of

FOLDS, HELD_OUT = 3, 1
POSITIVES, UNLABELLED = 1500, 3000
GRAMS = Ngrams(words=(1,), chars=(2, 3), bits=14, power=1.0)  # shares, so a text of one repeated word is no stronger than others
SHAPE = ("upper", "symbols", "digits", "lines", "repeats", "word_length")
STEPS, RATE, L2 = 120, 0.1, 1e-4
_UPPER, _DIGIT, _SYMBOL, _GAP = (np.zeros(256, bool) for _ in range(4))
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT[ord("0") : ord("9") + 1] = True
_SYMBOL[list(b"#*$%&|<>{}[]\\^~_=+@!/")] = True
_GAP[list(b" \t\n\r\x0b\x0c")] = True


def shape(docs: list[bytes]) -> np.ndarray:
    """The shares of each text that SHAPE names; zeros for texts without a word. Words on both sides of a window's edge are not compared."""
    sums = np.zeros((len(docs), 7))
    for owner, parts in windows_of(docs):
        for i, part in zip(owner, parts, strict=True):
            words = part.split()
            b = np.frombuffer(part, np.uint8)
            same = sum(x == y for x, y in zip(words, words[1:], strict=False))
            sums[i] += (_UPPER[b].sum(), _SYMBOL[b].sum(), _DIGIT[b].sum(), part.count(b"\n"), same, len(words), len(b) - _GAP[b].sum())
    size, words = np.maximum(1, sums[:, 6]), np.maximum(1, sums[:, 5])
    return np.stack([sums[:, 0] / size, sums[:, 1] / size, sums[:, 2] / size, sums[:, 3] / words, sums[:, 4] / words, sums[:, 6] / words], 1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    dense: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, docs: list[bytes]) -> np.ndarray:
        z = GRAMS.project(docs, self.weights[:, None])[:, 0] + (shape(docs) - self.centre) / self.scale @ self.dense + self.bias
        return sigmoid(z)


class Sample:
    """Features of a bounded sample on the driver: sparse n-grams, dense shape, which rows are positive."""

    def __init__(self, index, value, dense, positive):
        self.rows, self.dense, self.positive = Rows(index, value, GRAMS.size), dense, positive

    def scores(self, w, v, b):
        return self.rows.dot(w) + self.dense @ v + b


def fit(sample: Sample, prior: float | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights by full-batch Adam: of the non-negative risk, or, without a prior, of positives against unlabelled rows in equal weight."""
    p, u = sample.positive, ~sample.positive
    share = np.where(p, 1 / max(1, p.sum()), 1 / max(1, u.sum()))
    w, v, b = np.zeros(GRAMS.size), np.zeros(sample.dense.shape[1]), 0.0
    moments = [np.zeros(GRAMS.size + len(v) + 1) for _ in range(2)]
    for t in range(1, STEPS + 1):
        z = sample.scores(w, v, b)
        plus, minus = -sigmoid(-z) * share, sigmoid(z) * share  # slopes of the losses of calling a row 1 and 0
        if prior is None:
            g = np.where(p, plus, minus)
        else:
            loss = np.logaddexp(0, z) * share
            negative = loss[u].sum() - prior * loss[p].sum()
            slope = np.where(p, -prior * minus, minus)
            g = np.where(p, prior * plus, 0) + slope if negative >= 0 else -slope
        grad = np.concatenate((sample.rows.back(g) + L2 * w, sample.dense.T @ g + L2 * v, [g.sum()]))
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad * grad
        step = RATE * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * moments[0] / (np.sqrt(moments[1]) + 1e-8) / np.sqrt(1 + t / 20)
        w, v, b = w - step[: len(w)], v - step[len(w) : -1], b - step[-1]
    return w, v, float(b)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among unlabelled rows from scores of both that no fitted row takes part in, within [0.02, 0.98]."""
    cuts = np.unique(positive)
    above = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    others = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    slack = np.sqrt(np.log(4 / delta) / (2 * len(unlabelled))) + np.sqrt(np.log(4 / delta) / (2 * len(positive)))
    best = np.argmin((others + (1 + gamma) * slack) / above)
    return float(np.clip(others[best] / above[best], 0.02, 0.98))


def samples(documents: DataFrame, labels: DataFrame, positives: int, unlabelled: int, seed: int) -> DataFrame:
    """doc_id, text, label (1 positive, 0 unlabelled) of the two samples; nothing of the held-out fold."""
    train = fold("doc_id", FOLDS) != HELD_OUT
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & train).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")).filter("label = 1")
    ids = documents.select("doc_id").filter(F.col("doc_id").isNotNull() & train).distinct()
    rest = ids.join(marks.select("doc_id"), "doc_id", "left_anti").withColumn("label", F.lit(0))
    some = sample_rows(marks, "doc_id", seed, positives).unionByName(sample_rows(rest, "doc_id", seed, unlabelled))
    return labelled_texts(documents, some)


def train(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = 11) -> Model | None:
    """The fitted model, or None where one of the samples is empty."""

    def run(batches):
        for b in batches:
            docs = texts_of(b.column(1))
            for i, j in chunks([len(d) for d in docs], CHUNK):
                rows = list(GRAMS.sparse(docs[i:j]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array([x.astype("<u2").tobytes() for x, _ in rows], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in rows], pa.binary()), pa.array([x.astype("<f8").tobytes() for x in shape(docs[i:j])], pa.binary())], ["doc_id", "label", "index", "value", "dense"])

    rows = samples(documents, labels, positives, unlabelled, seed).select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("label").cast("int").alias("label"))
    t = rows.mapInArrow(run, "doc_id string, label int, index binary, value binary, dense binary").toArrow().sort_by("doc_id")
    positive = np.array(t.column("label").to_pylist(), np.int64) == 1
    if positive.sum() < 2 or (~positive).sum() < 2:
        return None
    index = [np.frombuffer(x.as_buffer(), "<u2") for x in t.column("index")]
    value = [np.frombuffer(x.as_buffer(), "<f4") for x in t.column("value")]
    dense = np.stack([np.frombuffer(x.as_buffer(), "<f8") for x in t.column("dense")])
    centre, scale = dense.mean(0), dense.std(0) + 1e-6
    dense = (dense - centre) / scale
    late = np.zeros(len(positive), bool)
    for rows_of in (np.flatnonzero(positive), np.flatnonzero(~positive)):
        late[rows_of[1::2]] = True

    def part(which):
        return Sample([index[i] for i in which], [value[i] for i in which], dense[which], positive[which])

    priors = []
    for fitted, other in ((~late, late), (late, ~late)):  # each half is scored by what was fitted to the other
        w = fit(part(np.flatnonzero(fitted)), None)
        there = part(np.flatnonzero(other))
        z = there.scores(*w)
        priors.append(estimate_prior(z[there.positive], z[~there.positive]))
    prior = float(np.mean(priors))
    w, v, b = fit(part(np.arange(len(positive))), prior)
    return Model(w.astype(np.float32), v, b, centre, scale, prior)


def score_quality(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted and the estimated class prior (null without a model) of every row."""
    model = train(documents, labels, positives, unlabelled)
    trim()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            docs = texts_of(batch.column(2))
            for i, j in chunks([len(d) for d in docs], CHUNK):
                score = np.full(j - i, 0.5) if model is None else model.score(docs[i:j])
                prior = pa.array([None if model is None else model.prior] * (j - i), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), prior], ["doc_id", "held_out", "score", "predicted", "prior"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, prior double")
