"""Training-order materialisation: every sequence gets a global slot, shards hold fixed-stride slots in order.

Texts are encoded by the byte-level rank file, each followed by ``end_id``; within an input partition the ids form one
stream, cut into sequences of ``length`` ids (the partition's last one is padded with ``end_id``). Sequence numbers run
gaplessly over the partitions. A keyed Feistel network over the next even power of two, cycle-walked into 0 .. N-1, turns
numbers into slots: a permutation that needs no sort and no table. Slots are range-partitioned into shards of ``per_shard``; shard
k holds slots k * per_shard onwards, each ``length`` little-endian unsigned 16- or 32-bit ids, so slot s of the training order
starts at byte (s - k * per_shard) * stride of shard k and a reader resumes by arithmetic alone. A shard is written under
an attempt's own name and renamed, so repeated tasks leave whole files.

Texts are encoded once: the sequences are written, compressed some hundred at a time, with their place in the input
partition; how many each partition has gives every sequence its number. The slots are dealt from that table and it is deleted.

Null and empty texts are one ``end_id`` each; repeated rows are encoded each time; ids take no part. An empty table writes no shard and
gives an empty result. A text may be longer than a sequence; it goes on in the next.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.llm.bpe import encode, encoding
from parcelspark.llm.common import discard, materialise, mix

LENGTH = 2048
PER_SHARD = 4096
ROUNDS = 6


def slots(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """The slot of every sequence number: a keyed permutation of 0 .. n-1."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.frombuffer(hashlib.shake_256(key.encode()).digest(8 * ROUNDS), "<u8")

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(index, np.uint64))
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def _stream(batches, ranks: str, pattern: str, end_id: int, length: int, kind: str):
    """Lists of whole sequences of a partition, as (rows, length) arrays; the last padded."""
    enc, held, size = encoding(ranks, pattern), [], 0
    for b in batches:
        for text in b.column(0).to_pylist():
            held.append(np.append(encode(text or "", enc), end_id).astype(kind))
            size += len(held[-1])
            if size >= 512 * length:
                every = np.concatenate(held)
                whole = size // length * length
                yield every[:whole].reshape(-1, length)
                held, size = [every[whole:]], size - whole
    if size:
        every = np.concatenate(held)
        yield np.append(every, np.full(-size % length, end_id, kind)).reshape(-1, length)


def materialise_training_order(documents: DataFrame, out: str, ranks: str, pattern: str, key: str, end_id: int = 50256, length: int = LENGTH, per_shard: int = PER_SHARD, text_col: str = "text") -> DataFrame:
    """Writes the shards under ``out`` (a URI of a shared file system), then returns slot, shard, byte_offset, n_bytes, crc32 of every sequence."""
    spark = documents.sparkSession
    kind = "<u2" if end_id < 1 << 16 else "<u4"
    texts = documents.select(F.col(text_col).alias("text"))

    def encoded(batches):
        part, done, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=6)
        for rows in _stream(batches, ranks, pattern, end_id, length, kind):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([done], pa.int64()), pa.array([len(rows)], pa.int64()), pa.array([pack.compress(rows.tobytes())], pa.binary())], ["part", "first", "n", "ids"])
            done += len(rows)

    sequences = materialise(texts.mapInArrow(encoded, "part int, first long, n long, ids binary"), "sequences")
    base, total = {}, 0
    for r in sequences.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row a partition
        base[r["part"]] = total
        total += r["n"]
    shared = spark.sparkContext.broadcast(base)

    def deal(batches):
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        for b in batches:
            for part, first, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = slots(shared.value[part] + first + np.arange(n), total, key)
                raw = unpack.decompress(ids)
                stride = len(raw) // n
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array([pack.compress(raw[i : i + stride]) for i in range(0, len(raw), stride)], pa.binary())], ["slot", "ids"])

    def write(batches):
        """Slots come in order; each shard is in one partition."""
        from pyarrow import fs

        stride = length * np.dtype(kind).itemsize
        target = shard = sink = temporary = None

        def close():
            if sink is not None:
                sink.close()
                store.move(temporary, target)

        unpack = zstandard.ZstdDecompressor()
        store, folder = fs.FileSystem.from_uri(out)
        store.create_dir(folder, recursive=True)
        for b in batches:
            s = b.column(0).to_numpy()
            for k in np.unique(s // per_shard).tolist():
                at = np.flatnonzero(s // per_shard == k)
                if k != shard:
                    close()
                    shard, target = k, f"{folder}/shard-{k:08d}.bin"
                    temporary = f"{target}.{uuid.uuid4().hex}"
                    sink = store.open_output_stream(temporary)
                raw = [unpack.decompress(b.column(1)[i].as_buffer()) for i in at.tolist()]
                for x in raw:
                    sink.write(x)
                yield pa.RecordBatch.from_arrays([pa.array(s[at]), pa.array([k] * len(at), pa.int64()), pa.array((s[at] - k * per_shard) * stride), pa.array([stride] * len(at), pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())], ["slot", "shard", "byte_offset", "n_bytes", "crc32"])
        close()

    dealt = sequences.mapInArrow(deal, "slot long, ids binary")
    placed = dealt.repartitionById(max(1, -(-total // per_shard)), F.floor(F.col("slot") / per_shard).cast("int")).sortWithinPartitions("slot")
    index = materialise(placed.mapInArrow(write, "slot long, shard long, byte_offset long, n_bytes long, crc32 long"), "index")
    discard(sequences)
    return index


def read_slots(spark: SparkSession, out: str, first: int, rows: int, length: int = LENGTH, per_shard: int = PER_SHARD, width: int = 2) -> list[np.ndarray]:
    """Sequences ``first`` .. ``first + rows`` - 1 of the training order: what a resumed reader does."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(out)
    stride, found = length * width, []
    for s in range(first, first + rows):
        with store.open_input_file(f"{folder}/shard-{s // per_shard:08d}.bin") as f:
            f.seek(s % per_shard * stride)
            raw = f.read(stride)
        if len(raw) < stride:
            break
        found.append(np.frombuffer(raw, f"<u{width}"))
    return found
