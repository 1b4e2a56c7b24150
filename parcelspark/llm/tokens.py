"""Token ids of whole texts by a ``tokenizers`` file, remembering the ids of white-space-separated chunks.

The word-level tokenizer drops white space before its merges, so a text's ids are its chunks' ids in order.
Only chunks not seen yet reach the library. That holds for tokenizers whose splitter never joins characters across
ASCII white space; :func:`check_separable` refuses others.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import _SEPARATOR, chunks, texts_of, trim

REMEMBERED, KEPT = 1_000_000, 400_000  # chunks known at most, about, and after that: the first met, which are the frequent ones
PART = 1000  # new chunks in one string given to the library
_MARK = b"\x01"


def check_separable(tokenizer) -> None:
    def ids(text):
        return tokenizer.encode(text, add_special_tokens=False).ids

    for left in ("a", "B1", "é!", "'s"):
        for gap in (" ", "\n", "\t \r\n"):
            if ids(left + gap + left) != ids(left) * 2:
                raise ValueError("this tokenizer keeps white space; its chunks can't be encoded on their own")


class ChunkEncoder:
    """ids of texts; ``lower`` says that the tokenizer lower-cases, so chunks that differ in ASCII case are one."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        check_separable(self.tokenizer)
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.lower = one("AbC") == one("abc") and one("Z") == one("z")
        mark = one(_MARK.decode())
        self.mark = mark[0] if len(mark) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def shrink(self, keep: int | None = None) -> None:
        """Forget all but the first ``keep`` chunks (KEPT)."""
        keep = KEPT if keep is None else keep
        if len(self.known) > keep:
            self.known = dict(islice(self.known.items(), keep))
            self.starts, self.lengths = self.starts[:keep].copy(), self.lengths[:keep].copy()
            self.used = int((self.starts + self.lengths).max(initial=0))
            self.flat = self.flat[: max(self.used, 1)].copy()

    def _learn(self, words: list[bytes]) -> None:
        easy = [w for w in words if _MARK not in w] if self.mark is not None else []
        hard = [w for w in words if _MARK in w] if self.mark is not None else words
        found = [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch([w.decode() for w in hard], add_special_tokens=False)] if hard else []
        if easy:
            parts = [(b" " + _MARK + b" ").join(easy[i : i + PART]).decode() for i in range(0, len(easy), PART)]
            ids = np.concatenate([np.asarray([*e.ids, self.mark], np.uint32) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
            edges = np.flatnonzero(ids == self.mark)
            begin = np.concatenate(([0], edges[:-1] + 1))
            self._append(easy, ids, begin, edges - begin)
        if hard:
            sizes = np.array([len(x) for x in found])
            self._append(hard, np.concatenate(found), np.cumsum(sizes) - sizes, sizes)

    def _append(self, words, ids, begin, sizes) -> None:
        n = len(self.known)
        while n + len(words) > len(self.starts):
            self.starts, self.lengths = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lengths))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[n : n + len(words)], self.lengths[n : n + len(words)] = begin + self.used, sizes
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each)."""
        if len(self.known) > REMEMBERED:
            self.shrink()
        # A special token's own text is matched before lower-casing, so texts that may hold one keep their case.
        parts = [d.lower() if self.lower and b"<|" not in d else d for d in docs]
        raw = b" ".join(parts)
        flat = raw.split()
        index = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        if len(late := np.flatnonzero(index < 0)):
            missed = [flat[i] for i in late.tolist()]
            fresh = list(dict.fromkeys(missed))
            for i, j in chunks([len(w) for w in fresh], 1 << 20):
                self._learn(fresh[i:j])
            index[late] = np.fromiter(map(self.known.__getitem__, missed), np.int64, len(missed))
        size = self.lengths[index]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.starts[index] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        space = _SEPARATOR[np.frombuffer(raw + b" ", np.uint8)]
        starts = np.flatnonzero(np.concatenate(([True], space[:-1])) & ~space)
        first = np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in parts)]))
        return ids, np.diff(np.concatenate(([0], ends))[first])


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", keep: int = KEPT) -> DataFrame:
    """Each document's ids, then ``end_id``, cut into pieces of ``capacity``: doc_id, piece, start, length, ids_crc32[, ids].

    Null text counts as empty: one piece of length 1. Between tasks a worker remembers ``keep`` chunks: fewer take less of what later stages have, more save encoding; with 0 it
    gives the tokenizer up too.
    """
    import zlib

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            docs = texts_of(b.column(1))
            for i, j in chunks([len(d) for d in docs], 2 << 20):
                flat, counts = enc.encode(docs[i:j])
                rows, at = [], 0
                for doc, n in zip(b.column(0).slice(i, j - i).to_pylist(), counts.tolist(), strict=True):
                    ids = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        raw = ids[start : start + capacity].tobytes()
                        rows.append((doc, k, start, len(raw) // 4, zlib.crc32(raw), *([raw] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        enc.shrink(keep)  # the worker lives on for later tasks
        if not keep:
            del enc
            encoder.cache_clear()
        trim()

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
