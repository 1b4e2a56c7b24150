"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted to at most ``SAMPLE`` vectors (least keyed hash) and every vector is filed in a leaf. A query takes
branches and leaves off a priority queue, nearest centre first. How many leaves it visits is calibrated: for up to
``CALIBRATION`` queries the exact neighbours among all rows are found in blocks, and the visits widen until their mean recall reaches
the target; a query goes on beyond them until its leaves hold k other rows. Leaves with many rows are cut into blocks. Scores of what is found are exact double-precision inner products,
summed in component order; ties go to the smaller id. Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows with a null id. Rows that repeat an id are candidates each, but never of a query with that id; of a repeated query id the least vector
asks. Other columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelspark.llm.common import materialise, sample_rows

SAMPLE = 32_768
CALIBRATION = 200
FAN = 32  # branches of a node
LEAF_ROWS = 1024
MAX_LEAVES = 16_384
BLOCK = 4096
QUERIES = 8192  # of one leaf that meet a block at a time
RECALL = 0.95


def k_means(x: np.ndarray, k: int, rng, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centres, assignment); empty clusters are dropped."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        used = np.unique(own)
        centres = np.stack([x[own == c].mean(0) for c in used])
    return centres, np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)


class Tree:
    """Nodes of up to FAN centres each, down to the leaves. Inner product is searched through the centres' own inner product with the query."""

    def __init__(self, x: np.ndarray, leaves: int, seed: int = 5):
        self.nodes: list[tuple[np.ndarray, np.ndarray]] = []  # centres; below them: a node's number, or -1 less a leaf's
        self.leaves = 0
        self._grow(x, max(1, leaves), np.random.default_rng(seed))

    def _grow(self, x: np.ndarray, leaves: int, rng) -> int:
        me = len(self.nodes)
        self.nodes.append((x[:0], np.zeros(0, np.int64)))
        fan = leaves if leaves <= FAN else max(2, min(FAN, round(leaves ** 0.5)))
        centres, own = k_means(x, fan, rng)
        below = []
        for c in range(len(centres)):
            inner = x[own == c]
            share = round(leaves * len(inner) / len(x))
            if leaves > FAN and share > 1 and len(inner) < len(x):
                below.append(self._grow(inner, share, rng))
            else:
                below.append(-1 - self.leaves)
                self.leaves += 1
        self.nodes[me] = centres, np.array(below, np.int64)
        return me

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre's, level by level."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            centres, below = self.nodes[node]
            near = np.argmax(x[rows] @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
            for c in np.unique(near):
                at = rows[near == c]
                if below[c] < 0:
                    out[at] = -1 - below[c]
                else:
                    todo.append((int(below[c]), at))
        return out

    def visit(self, q: np.ndarray, most: int, sizes: dict[int, int] | None = None, rows: int = 0) -> list[int]:
        """``most`` leaves in the order of a best-bin-first traversal, and further ones until they hold ``rows`` rows."""
        queue: list[tuple[float, int]] = [(0.0, 0)]
        out: list[int] = []
        held = 0
        while queue and (len(out) < most or held < rows):
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                held += sizes.get(-1 - node, 0) if sizes else 0
                continue
            centres, below = self.nodes[node]
            for s, b in zip((centres @ q).tolist(), below.tolist(), strict=True):
                heapq.heappush(queue, (-s, b))
        return out


def vectors_of(column) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def block_top(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int):
    """The k best of a block for each query: (query number, position), by query, falling score and rising id, and the scores.

    Scores are exact for all that the matrix product can't rule out.
    """
    near = q @ x.T
    near[query_ids[:, None] == ids[None, :]] = -np.inf
    if near.shape[1] > k:
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        least = least - 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(least), least, 0)))
    else:
        least = np.full(len(q), -np.inf)
    row, at = np.nonzero((near >= least[:, None]) & np.isfinite(near))
    score = np.zeros(len(row))
    for d in range(q.shape[1]):
        score += x[at, d] * q[row, d]
    order = np.lexsort((ids[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], at[keep], score[keep]


def _merge(k: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores, leaves = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)
        for b in batches:
            ids, scores, leaves = (np.concatenate((a, b.column(c).flatten().to_numpy())) for a, c in ((ids, "ids"), (scores, "scores"), (leaves, "leaves")))
            order = np.lexsort((ids, -scores))[:k]
            ids, scores, leaves = ids[order], scores[order], leaves[order]
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0].as_py(), np.int64)), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array(ids), pa.array(scores), pa.array(leaves.astype(np.int32))], ["query_id", "rank", "vec_id", "score", "leaf"])

    return run


PARTIAL = "query_id long, ids array<bigint>, scores array<double>, leaves array<int>"
FOUND = "query_id long, rank int, vec_id long, score double, leaf int"


def _partial(query_ids: np.ndarray, row, ids, scores, leaves) -> pa.RecordBatch:
    """One row for each query with what it found."""
    edges = pa.array(np.searchsorted(row, np.arange(len(query_ids) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(query_ids), *(pa.ListArray.from_arrays(edges, pa.array(x)) for x in (ids, scores, leaves.astype(np.int32)))], ["query_id", "ids", "scores", "leaves"])


def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (size["n"] if size else 0))


def brute_force(filed: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """Exact neighbours of a bounded list of queries among all rows, block by block."""
    shared = filed.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        q, qid = np.array([v for _, v in shared.value]), np.array([i for i, _ in shared.value])
        for b in batches:
            ids, x, leaf = b.column(0).to_numpy(), vectors_of(b.column(1)), b.column(2).to_numpy()
            row, at, score = block_top(ids, x, qid, q, k)
            yield _partial(qid, row, ids[at], score, leaf[at])

    return filed.select("vec_id", "v", "leaf").mapInArrow(run, PARTIAL).groupBy("query_id").applyInArrow(_merge(k), FOUND)


def nearest(embeddings: DataFrame, query_filter, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for every row that ``query_filter`` (on vec_id) takes."""
    rows = usable(embeddings, id_col, vector_col)
    spark = rows.sparkSession
    n = rows.count()
    sample = sample_rows(rows, "vec_id", seed, SAMPLE).select("v").toArrow()  # bounded by SAMPLE
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(vectors_of(sample.column("v").combine_chunks()), min(MAX_LEAVES, max(1, n // LEAF_ROWS)))
    shared = spark.sparkContext.broadcast(tree)

    def file(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.file(vectors_of(b.column(1))), pa.int32())], ["vec_id", "v", "leaf"])

    filed = materialise(rows.mapInArrow(file, "vec_id long, v array<double>, leaf int"), "filed")
    asked = filed.filter(query_filter).groupBy("vec_id").agg(F.min("v").alias("v"))
    # Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest: a much-copied vector leaves no more in the search.
    again = F.dense_rank().over(Window.partitionBy("leaf", "v").orderBy("vec_id"))
    searched = materialise(filed.withColumn("again", again).filter(F.col("again") <= k + 1).drop("again"), "searched")
    trial = [(r["vec_id"], r["v"]) for r in sample_rows(asked, "vec_id", seed, CALIBRATION).collect()]
    exact = brute_force(filed, trial, k).select("query_id", "leaf").collect() if trial else []
    order = {q: {leaf: i for i, leaf in enumerate(tree.visit(np.array(v), tree.leaves))} for q, v in trial}
    ranks = np.sort([order[r["query_id"]][r["leaf"]] for r in exact])
    if not trial:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    visits = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1

    sizes = {r["leaf"]: r["count"] for r in searched.groupBy("leaf").count().collect()}  # MAX_LEAVES rows at most
    held_rows = spark.sparkContext.broadcast(sizes)

    def ask(batches):
        for b in batches:
            x = vectors_of(b.column(1))
            leaf, block, row = [], [], []
            for i, q in enumerate(x):
                for c in shared.value.visit(q, visits, held_rows.value, k + 1):
                    for j in range(-(-held_rows.value.get(c, 0) // BLOCK)):
                        leaf.append(c)
                        block.append(j)
                        row.append(i)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(block, pa.int32()), b.column(0).take(at), b.column(1).take(at)], ["leaf", "block", "query_id", "q"])

    wanted = asked.select("vec_id", "v").mapInArrow(ask, "leaf int, block int, query_id long, q array<double>")
    wanted = materialise(wanted, "wanted")
    # Into how many blocks a leaf's rows and slices its queries are cut: MAX_LEAVES rows at most, hence broadcast.
    cuts = [(r["leaf"], -(-sizes[r["leaf"]] // BLOCK), -(-r["count"] // QUERIES)) for r in wanted.filter("block = 0").groupBy("leaf").count().collect()]
    cuts = F.broadcast(spark.createDataFrame(cuts, "leaf int, blocks int, slices int"))
    held = searched.join(cuts, "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    held = held.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("leaf", "block", "slice", "vec_id", "v")
    wanted = wanted.join(cuts, "leaf").withColumn("slice", F.pmod(F.xxhash64("query_id"), "slices").cast("int")).select("leaf", "block", "slice", "query_id", "q")

    def search(left, right):
        if not left.num_rows or not right.num_rows:
            none = np.zeros(0, np.int64)
            return pa.Table.from_batches([_partial(none, none, none, np.zeros(0), none)])
        ids, x = left.column("vec_id").to_numpy(), vectors_of(left.column("v").combine_chunks())
        leaf = int(left.column("leaf")[0].as_py())
        qid, q = right.column("query_id").to_numpy(), vectors_of(right.column("q").combine_chunks())
        parts = []
        for i in range(0, len(q), 512):
            row, at, score = block_top(ids, x, qid[i : i + 512], q[i : i + 512], k)
            parts.append(_partial(qid[i : i + 512], row, ids[at], score, np.full(len(at), leaf)))
        return pa.Table.from_batches(parts)

    partial = held.groupBy("leaf", "block", "slice").cogroup(wanted.groupBy("leaf", "block", "slice")).applyInArrow(search, PARTIAL)
    return partial.groupBy("query_id").applyInArrow(_merge(k), FOUND).select("query_id", "rank", "vec_id", "score")

