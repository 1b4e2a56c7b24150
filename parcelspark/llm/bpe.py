"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut at safe boundaries before they are encoded: places where the pre-splitting pattern
starts a new match whatever stands around them, so the ids of the parts are the ids of the whole.
Long runs of white space, which the pattern's engine can't match at once, are taken out by the pattern's own rule:
before another character all but the last of the run are one match, at the text's end all of it.
Null and empty texts have no ids. Token id lists are exact for any text; a lone surrogate cannot occur in
Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A letter or digit, then one space, then a letter: the pattern's `\p{L}+` or `\p{N}+` run ends before the
# space, and ` ?\p{L}+` starts with it. ASCII neighbours suffice as there are enough of them.
_SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z])")
PART = 1 << 16
# Fixed value: the characters that the pattern's \s takes.
_GAP = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = PART):
    """Cut ``text`` into parts of about ``size`` characters at safe boundaries only."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=4)
def _long_gap(size: int) -> re.Pattern:
    return re.compile(f"[{_GAP}]{{{size},}}")


def encode(text: str, enc, size: int = PART) -> np.ndarray:
    parts, at = [], 0
    for m in _long_gap(size).finditer(text) if len(text) > size else ():
        end = m.end() - (m.end() < len(text))
        parts += [enc.encode_to_numpy(p, disallowed_special=()) for p in safe_parts(text[at : m.start()], size)]
        parts.append(np.array(enc._encode_single_piece(text[m.start() : end]), np.uint32))
        at = end
    parts += [enc.encode_to_numpy(p, disallowed_special=()) for p in safe_parts(text[at:], size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(ids: np.ndarray, enc) -> bytes:
    """Raw bytes of the ids; they need not be whole characters."""
    return enc.decode_bytes(ids.tolist())


def encode_documents(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids binary as little-endian u32) of every row; null text counts as empty."""

    def run(batches):
        enc = encoding(ranks, pattern)
        for b in batches:
            ids = [encode(t or "", enc) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["id", "n_tokens", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, ranks: str, pattern: str, ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """Adds the decoded bytes of ``ids_col``."""

    def run(batches):
        enc = encoding(ranks, pattern)
        for b in batches:
            raw = [decode(np.frombuffer(x or b"", "<u4"), enc) for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], [*b.schema.names, out])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {out} binary")


def sha256_hex(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def digests(df: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of decoded bytes: the round trip of every text, one narrow stage."""
    out = decode_documents(encode_documents(df, ranks, pattern), ranks, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
