"""Boosted trees for quantiles: pinball loss, trees grown level by level on summed histograms, leaves set to quantiles of residuals.

All quantiles grow in the same passes. A pass sends each task the model so far and gets back counts: of rows, and of rows below the prediction, by tree node, feature and bin.
Counts are whole numbers, so with given bins splits don't depend on how rows are dealt; they are added up in a tree of tasks, and the driver sees one array of fixed size a pass, never rows.
A leaf moves by the quantile of its residuals, read from a histogram of ``GRID`` steps. Predictions of one row are put in order, so quantiles do not cross.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.operators.stages import settled
from parcelspark.operators.treesum import tree_sum

BINS = 64
GRID = 512


@dataclass
class Trees:
    """``rounds``: for each round and quantile (feature, bin) of the inner nodes in heap order and the leaves' values; rows of a bin up to ``cut`` go left."""

    features: list[str]
    quantiles: tuple[float, ...]
    edges: list[np.ndarray]
    start: np.ndarray
    depth: int
    rounds: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=list)

    def binned(self, batch: pa.RecordBatch) -> np.ndarray:
        """(features, rows) bins; missing values fall in the last one."""
        return np.stack([np.searchsorted(e, _numbers(batch, f), "right") for f, e in zip(self.features, self.edges, strict=True)]).astype(np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(quantiles, rows), as boosted: not yet in order."""
        out = np.repeat(self.start[:, None], x.shape[1], 1)
        for trees in self.rounds:
            for k, (feature, cut, value) in enumerate(trees):
                out[k] += value[nodes_of(x, feature, cut, self.depth) - (1 << self.depth) + 1]
        return out


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _packed(x: np.ndarray) -> pa.Array:
    """(features, rows) bins as one binary value a row."""
    ends = np.arange(x.shape[1] + 1, dtype=np.int32) * x.shape[0]
    return pa.Array.from_buffers(pa.binary(), x.shape[1], [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x.T))])


def _unpacked(bins: pa.Array, features: int) -> np.ndarray:
    ends = np.frombuffer(bins.buffers()[1], np.int32)[bins.offset : bins.offset + len(bins) + 1]
    return np.ascontiguousarray(np.frombuffer(bins.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(bins), features).T)


def nodes_of(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The heap number of each row's node ``levels`` below the root."""
    node = np.zeros(x.shape[1], np.int64)
    for _ in range(levels):
        node = 2 * node + 1 + (x[feature[node], np.arange(len(node))] > cut[node])
    return node


def best_splits(counts: np.ndarray, quantile: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, bin) for each node of a (nodes, features, bins, 2) array of rows and rows below: the most reduction of squared gradients; all left where none leaves ``least`` on both sides."""
    left = counts.cumsum(2)[:, :, :-1].astype(float)
    total = counts.sum(2)[:, :, None].astype(float)
    right = total - left

    def gain(c):
        return (quantile * c[..., 0] - c[..., 1]) ** 2 / np.maximum(1, c[..., 0])

    score = gain(left) + gain(right) - gain(total)
    score[(left[..., 0] < least) | (right[..., 0] < least)] = -1
    flat = score.reshape(len(score), -1)
    best = flat.argmax(1)
    none = flat[np.arange(len(flat)), best] <= 1e-9
    feature, cut = np.divmod(best, score.shape[2])
    return np.where(none, 0, feature), np.where(none, BINS, cut)


def histogram_quantile(counts: np.ndarray, low: float, step: float, quantile: float) -> float:
    """The quantile of values counted in steps from ``low`` on, spread evenly within a step; 0 of none."""
    n = counts.sum()
    if not n:
        return 0.0
    sums = np.cumsum(counts)
    at = int(np.searchsorted(sums, quantile * n, "left"))
    inside = (quantile * n - (sums[at] - counts[at])) / counts[at]
    return low + step * (at + inside)


def fit(rows: DataFrame, features: list[str], target: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), rounds: int = 12, depth: int = 3, rate: float = 0.2, least: int = 60) -> Trees:
    """Trees for ``quantiles`` of ``target``. Rows without a target are left out; features may be null. ``rows`` is read to be put in bins, which a pass reads: give a written or checkpointed table."""
    rows = rows.filter(F.col(target).isNotNull()).select(*(F.col(f).cast("double").alias(f) for f in features), F.col(target).cast("double").alias(target))
    span = rows.agg(F.min(target).alias("lo"), F.max(target).alias("hi")).first()
    if span.lo is None:
        raise ValueError("no row to learn from")
    cuts = rows.approxQuantile([*features, target], [i / BINS for i in range(1, BINS)], 0.001)
    edges = [np.unique(np.array(c)) for c in cuts[:-1]]
    start = np.array([cuts[-1][int(np.clip(round(q * BINS) - 1, 0, BINS - 2))] for q in quantiles])
    model = Trees(features, quantiles, edges, start, depth)
    wide = max(1e-9, span.hi - span.lo)
    spark, nq, nf = rows.sparkSession, len(quantiles), len(features)
    bare = spark.sparkContext.broadcast(model)

    def in_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([_packed(bare.value.binned(b)), pa.array(_numbers(b, target))], ["bins", "y"])

    rows = settled(rows.mapInArrow(in_bins, "bins binary, y double"))

    for _ in range(rounds):
        feature, cut = np.zeros((nq, (1 << depth) - 1), np.int64), np.full((nq, (1 << depth) - 1), BINS, np.int64)
        for level in range(depth):
            width = 1 << level
            shared = spark.sparkContext.broadcast((model, feature, cut))
            size = nq * width * nf * BINS * 2

            def counted(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
                model, feature, cut = shared.value  # noqa: B023
                out = np.zeros(size, np.int64)  # noqa: B023
                for b in filter(len, batches):
                    x, y = _unpacked(b.column(0), nf), _numbers(b, "y")
                    for k, f in enumerate(model.predict(x)):
                        node = nodes_of(x, feature[k], cut[k], level) - width + 1 + k * width  # noqa: B023
                        below = (y < f).astype(np.int64)
                        for j in range(nf):
                            cell = (node * nf + j) * BINS + x[j]
                            out[0::2] += np.bincount(cell, minlength=size // 2)  # noqa: B023
                            out[1::2] += np.bincount(cell[below == 1], minlength=size // 2)  # noqa: B023
                return out

            counts = tree_sum(rows, size, counted).reshape(nq, width, nf, BINS, 2)
            for k, q in enumerate(quantiles):
                feature[k, width - 1 : 2 * width - 1], cut[k, width - 1 : 2 * width - 1] = best_splits(counts[k], q, least)
            shared.unpersist()
        leaves = 1 << depth
        shared = spark.sparkContext.broadcast((model, feature, cut))

        def residuals(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            model, feature, cut = shared.value  # noqa: B023
            out = np.zeros(nq * leaves * GRID, np.int64)  # noqa: B023
            for b in filter(len, batches):
                x, y = _unpacked(b.column(0), nf), _numbers(b, "y")
                for k, f in enumerate(model.predict(x)):
                    leaf = nodes_of(x, feature[k], cut[k], depth) - leaves + 1 + k * leaves  # noqa: B023
                    step = np.clip((y - f + wide) / (2 * wide) * GRID, 0, GRID - 1).astype(np.int64)
                    out += np.bincount(leaf * GRID + step, minlength=len(out))
            return out

        counts = tree_sum(rows, nq * leaves * GRID, residuals).reshape(nq, leaves, GRID)
        values = [rate * np.array([histogram_quantile(counts[k, i], -wide, 2 * wide / GRID, q) for i in range(leaves)]) for k, q in enumerate(quantiles)]
        model.rounds.append([(feature[k], cut[k], values[k]) for k in range(nq)])
        shared.unpersist()
    return model


def predicted(model: Trees, rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and one column for each quantile (p25, p50, ...), in order in every row."""
    names = [f"p{round(100 * q):02d}" for q in model.quantiles]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            p = np.sort(model.predict(model.binned(b)), 0)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *(pa.array(x) for x in p)], [*keep, *names])

    some = rows.select(*keep, *(F.col(f).cast("double").alias(f) for f in model.features if f not in keep))
    return some.mapInArrow(run, ", ".join([*(f"{c} {some.schema[c].dataType.simpleString()}" for c in keep), *(f"{n} double" for n in names)]))


def best_offers(model: Trees, rows: DataFrame, key: str, price: str, wanted: str, most: float) -> DataFrame:
    """``key``, hit (the highest ``price`` at which ``wanted``, p50 say, is ``most`` or less) and near (the price of the least ``wanted``, the lowest of equal ones), each with its ``wanted``.

    Rows of one key that stand together are reduced to one before they are shuffled.
    """
    names = [f"p{round(100 * q):02d}" for q in model.quantiles]
    shared, at = rows.sparkSession.sparkContext.broadcast(model), names.index(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in filter(len, batches):
            p, x = np.sort(model.predict(model.binned(b)), 0)[at], _numbers(b, price)
            keys = b.column(b.schema.get_field_index(key))
            k = keys.to_numpy(zero_copy_only=False)
            run_of = np.cumsum(np.r_[False, k[1:] != k[:-1]])
            last = np.r_[np.flatnonzero(np.diff(run_of)), len(k) - 1]
            hit = np.lexsort((x, p <= most, run_of))[last]  # the last of each run: the highest price of those that will do
            near = np.lexsort((-x, -p, run_of))[last]
            none = p[hit] > most
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(last)), *(pa.array(v, mask=m) for v, m in ((x[hit], none), (p[hit], none), (x[near], None), (p[near], None)))], [key, "hit", "hit_p", "near", "near_p"])

    some = rows.select(key, *(F.col(f).cast("double").alias(f) for f in dict.fromkeys([price, *model.features])))
    runs = some.mapInArrow(run, f"{key} {some.schema[key].dataType.simpleString()}, hit double, hit_p double, near double, near_p double")
    pair = lambda a, b: F.struct(F.col(a).alias(a), F.col(b).alias(b))
    best = runs.groupBy(key).agg(F.max(F.when(F.col("hit").isNotNull(), pair("hit", "hit_p"))).alias("h"), F.min(pair("near_p", "near")).alias("n"))
    return best.select(key, "h.hit", "h.hit_p", "n.near", "n.near_p")
