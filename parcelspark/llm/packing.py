"""Best-fit packing with certified repacking.

Pieces are dealt over partitions and packed best-fit decreasing. A dual-feasible-function lower bound certifies a
partition whose bin count meets it. Partitions that have a gap, and every certified partition's emptiest bin, exchange pieces: what
those bins held is dealt anew, over fewer partitions each round, and packed again. A round is kept only if it needs
fewer bins, so the count never rises, and the rounds end when the count meets the bound of the whole table.

Each piece has a key of its own, so ids may be null or repeated: every row of the table is packed. Null and empty texts are
one piece of the end id. An empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import discard, materialise
from parcelspark.llm.tokens import KEPT, pieces

PER_PARTITION = 60_000
ROUNDS = 4


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: longest first, each into the fullest bin that still holds it.

    Open bins wait by their room; a bit mask of the rooms that occur finds the least that suffices.
    """
    out = np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        out[i] = b
        left = room - n
        if left:
            rooms[left].append(b)
            mask |= 1 << left
    return out


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Least number of bins by dual feasible functions, from the number of items of each length 0..capacity.

    u(k): over-half items count 1, items under k count 0, the rest their share (every k up to half);
    f(k): the rounding function floor((k+1) x / C), or x k / C where that is whole, over k, for k up to 20.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    total = int((counts * x).sum())
    best = -(-total // capacity)
    n_from = np.cumsum(counts[::-1])[::-1]  # items of at least this length
    mass_to = np.cumsum(counts * x)
    for k in range(1, capacity // 2 + 1):
        big = int(n_from[capacity - k + 1]) if k else 0
        mid = int(mass_to[capacity - k] - mass_to[k - 1])
        best = max(best, big + -(-mid // capacity))
    for k in range(1, 21):
        whole = ((k + 1) * x) % capacity == 0
        value = np.where(whole, (k + 1) * x * k, capacity * (((k + 1) * x) // capacity) * (k + 1))  # times k (k+1) C
        best = max(best, -(-int((counts * value).sum()) // (k * (k + 1) * capacity)))
    return best


def _pack(rows: DataFrame, capacity: int, parts: int, round_no: int) -> DataFrame:
    """Deals the rows (key, length) over ``parts`` by a hash and packs each; adds part, bin, offset, filled, the part's certified gap and its emptiest bin."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key", F.lit(round_no)), F.lit(parts)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        b = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        filled = np.bincount(b, weights=lengths).astype(np.int64)
        order = np.argsort(b, kind="stable")
        ends = np.cumsum(lengths[order])
        offset = np.empty(len(b), np.int64)
        offset[order] = ends - lengths[order] - np.concatenate(([0], np.cumsum(filled)))[b[order]]
        return pd.DataFrame({"key": pdf["key"], "length": lengths, "part": pdf["part"], "bin": b, "offset": offset, "filled": filled[b], "gap": len(filled) - bound, "emptiest": b == int(filled.argmin())})

    return dealt.groupBy("part").applyInPandas(run, "key long, length long, part int, bin long, offset long, filled long, gap long, emptiest boolean")


def _bins(packed: DataFrame) -> int:
    return packed.groupBy("part").agg((F.max("bin") + 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def whole_bound(items: DataFrame, capacity: int) -> int:
    """Lower bound of the bins that all items (length) need; the lengths' histogram has ``capacity`` rows at most."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return lower_bound(counts, capacity)


def pack_lengths(items: DataFrame, capacity: int) -> DataFrame:
    """key (unique), length -> key, sequence_id, offset. Full-length items are sequences of their own, numbered below 0.

    The other numbers hold the round, the partition and the bin.
    """
    rows = items.select("key", "length")
    short = rows.filter(F.col("length") < capacity)
    n = short.count()
    settled = [rows.filter(F.col("length") == capacity).select("key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]

    def numbered(x, r):
        return x.select("key", (F.lit(r).cast("long") * (1 << 60) + F.col("part") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id"), "offset")

    packed, current = materialise(_pack(short, capacity, max(1, math.ceil(n / PER_PARTITION)), 0), "packed"), 0
    bins, least = _bins(packed), whole_bound(short, capacity)
    for r in range(1, ROUNDS + 1):
        # Loose: bins with over 1/64 of room left in partitions with a gap; of a certified partition the emptiest bin,
        # which is the slack that the whole can still share.
        slack = F.col("filled") < capacity - capacity // 64
        loose = slack & ((F.col("gap") > 0) | F.col("emptiest"))
        pool = packed.filter(loose)
        m = pool.count()
        parts = math.ceil(m / PER_PARTITION)
        if bins <= least or not m or (parts == 1 and r > 2):
            break
        again = materialise(_pack(pool.select("key", "length"), capacity, parts, r), "packed")
        before, after = pool.select("part", "bin").distinct().count(), _bins(again)
        if after >= before:
            discard(again)
            continue
        settled.append(numbered(packed.filter(~loose), current))
        packed, current, bins = again, r, bins - before + after
    settled.append(numbered(packed, current))
    every = settled[0]
    for x in settled[1:]:
        every = every.unionByName(x)
    return every


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep: int = KEPT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document; ``keep`` as in :func:`pieces`."""
    cut = materialise(pieces(docs, tokenizer, capacity, end_id, keep=keep).withColumn("key", F.monotonically_increasing_id()), "pieces")
    return cut.join(pack_lengths(cut, capacity), "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
