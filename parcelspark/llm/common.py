"""Shared helpers: scratch tables in the cluster's shared folder, label folds, word hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but these bytes (space and \t..\r); UTF-8 never uses them inside a character.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
WINDOW = 1 << 18
BATCH_BYTES = 8 << 20  # of rows that go to Python at once, about


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset: beside the warehouse tables, or, when Spark runs in one process (tests), a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.parcelspark.scratch", None)
    if root is None:
        if spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="parcelspark-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/parcelspark-scratch"
        spark.conf.set("spark.parcelspark.scratch", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors. What planning it has left on the driver is freed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    trim()
    df.sparkSession.sparkContext._jvm.System.gc()  # else the heap grows from plan to plan and is not given back
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give the driver's freed memory back after a model is trained: Arrow's pool and, with glibc, the C heap."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def scratch_table(stack: ExitStack, df: DataFrame, name: str) -> DataFrame:
    """:func:`materialise`, deleted when ``stack`` closes, on errors too."""
    out = materialise(df, name)
    stack.callback(discard, out)
    return out


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``: splits labels into folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def sample_rows(df: DataFrame, key: str, seed: int, rows: int) -> DataFrame:
    """A bounded, repeatable sample: the ``rows`` rows of least keyed hash (ties to the smaller key).

    The table is counted first, and only rows whose hash lies below some twice the share that is wanted are sorted.
    """
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40))
    share = min(1.0, (2 * rows + 200) / max(1, df.count()))
    return df.filter(draw <= int(share * (1 << 40))).orderBy(draw, F.col(key)).limit(rows)


def labelled_texts(documents: DataFrame, some: DataFrame) -> DataFrame:
    """doc_id, text, label of the bounded sample ``some`` (doc_id, label): one row an id, of a repeated id the least text."""
    return documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """Settings of the whole session, for the programs that run the operators (the operators leave them alone).

    Texts go to Python ``rows`` at a time and some BATCH_BYTES, so a batch of long ones stays small; shuffle files go when their query has ended.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def merge_parts(rows: DataFrame, combine, fan: int = 256, last=None, schema: str = "part int, data binary") -> DataFrame:
    """(part int, data binary) rows of which ``combine`` (an iterator of bytes -> bytes) makes one a part.

    Merged in two levels, ``fan`` map tasks at a time first, so no task reads what all map tasks wrote. ``last`` (part, bytes -> a batch of ``schema``)
    makes what is given back in the same worker: a step after it would hold a second one for each core.
    """

    def one(part: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])

    def by(made):
        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            data = combine(x.as_py() for b in batches for x in b.column("data"))  # one copy at a time
            yield made(key[0].as_py(), data)

        return run

    some = rows.withColumn("near", F.floor(F.spark_partition_id() / fan).cast("int"))
    once = some.groupBy("part", "near").applyInArrow(by(one), "part int, data binary")
    return once.groupBy("part").applyInArrow(by(last or one), schema)


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, nulls as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(sizes, most: int):
    """Consecutive (start, end) ranges of items holding about ``most`` bytes each."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


@lru_cache(maxsize=1)
def _all_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base):
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return of(_BASE), of(_BASE_INV)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``size`` powers, at least. Workers live on, so they keep one table for all sizes but those of words beyond a window, which are not kept."""
    usual = 2 * WINDOW
    return _all_powers(usual) if size <= usual else _all_powers.__wrapped__(size)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(docs: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of every text in order, number of words of each text).

    Runs over windows that end between words, so long texts need no more memory than a window
    (or their longest word).
    """
    buf = np.frombuffer(b" ".join(docs) + b" ", np.uint8)
    ends_of_docs = np.cumsum([len(d) + 1 for d in docs])
    hashes, starts_all = [], []
    at = 0
    while at < len(buf):
        stop = min(at + WINDOW, len(buf))
        while not _SEPARATOR[buf[stop - 1]]:
            following = np.flatnonzero(_SEPARATOR[buf[stop : stop + WINDOW]])
            stop = stop + (int(following[0]) + 1 if len(following) else WINDOW)
        part = buf[at:stop]
        edge = np.diff(np.concatenate(([1], _SEPARATOR[part].view(np.int8))))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        size = 1 << max(10, int(len(part)).bit_length())
        power, inverse = _powers(size)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_LOWER[part] if lower else part).astype(np.uint64) * power[: len(part)] + power[: len(part)], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
        hashes.append(mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40))))
        starts_all.append(starts + at)
        at = stop
    starts = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], ends_of_docs))))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words (runs may cross texts; callers cut them)."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, np.uint64(width * 0x632BE59BD9B4E019 & (2**64 - 1)), np.uint64)
    for j in range(width):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + hashes[j : j + n])
    return out


def shingle_sets(docs: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct ``width``-word shingle hashes of each text; a shorter text is one shingle, a wordless one none."""
    hashes, counts = word_hashes(docs)
    runs = windows(hashes, width)
    out, at = [], 0
    for n in counts:
        if n >= width:
            out.append(np.unique(runs[at : at + n - width + 1]))
        elif n:
            out.append(windows(hashes[at : at + n], int(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
