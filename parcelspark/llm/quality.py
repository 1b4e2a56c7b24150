"""Quality rules: base counts of each text, then a calibrated n-gram classifier against fixed thresholds.

The model is logistic regression on hashed word and character n-grams, fitted to at most ``SAMPLE`` labelled rows of
each class (those of least keyed hash), two thirds for the weights and a third for Platt scaling. Every whole text is
scored, a window at a time where it is long. Null and empty texts have zero counts and fail the base rules. With no labels of both classes
the verdict rests on the base rules alone. Ids are only carried: repeated rows have equal results, and a row with a null id is scored but never
learned from; of a repeated id one text, the least, is learned from. Empty tables give an empty result.
"""

from __future__ import annotations

from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import _SEPARATOR, chunks, labelled_texts, sample_rows, texts_of, windows, word_hashes
from parcelspark.llm.linear import Ngrams, Rows, calibrate, collect_features, fit, sigmoid

SAMPLE = 1500
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP = 0.5
GRAMS = Ngrams(words=(1, 2), chars=(3, 4), bits=15)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(flags[i:j]) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], np.int64)


def repeated_lines(doc: bytes) -> int:
    if len(doc) < 1 << 20:
        lines = doc.split(b"\n")
        if len(set(lines)) == len(lines):
            return 0
    else:
        lines = (line.removesuffix(b"\n") for line in BytesIO(doc))  # never all of them at once
    seen, n = set(), 0
    for line in lines:
        if not line.strip(b" \t\n\r\x0b\x0c"):
            continue
        n += line in seen
        seen.add(line)
    return n


def base_counts(docs: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    buf = np.frombuffer(b" ".join(docs) + b" ", np.uint8)
    edges = np.concatenate(([0], np.cumsum([len(d) + 1 for d in docs])))
    hashes, counts = word_hashes(docs, lower=False)
    ends = np.cumsum(counts)
    total = len(hashes)
    run = windows(hashes, 3)
    del hashes
    if len(docs) == 1:
        order = np.argsort(run)
        run = run[order]
        same = run[1:] == run[:-1]
    else:
        doc = np.repeat(np.arange(len(docs)), counts)
        at = np.flatnonzero(np.arange(len(run)) + 3 <= ends[doc[: len(run)]])
        order = at[np.lexsort((run[at], doc[at]))]
        same = (run[order][1:] == run[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(total + 1, bool)
    for j in range(3):
        covered[order[twice] + j] = True
    word_edges = np.concatenate(([0], ends)).astype(np.int64)
    return {
        "n_words": counts.astype(np.int64),
        "word_chars": per_text(~_SEPARATOR[buf] & ((buf & 0xC0) != 0x80), edges),
        "n_symbols": per_text(_SYMBOL[buf], edges),
        "n_dup_lines": np.array([repeated_lines(d) for d in docs], np.int64),
        "n_repeat_words": per_text(covered[:-1], word_edges),
    }


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 1):
    """(weights, bias, a, c) from the sampled labelled rows, or None without both classes."""
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    some = sample_rows(marks.filter("label = 1"), "doc_id", seed, sample).unionByName(sample_rows(marks.filter("label = 0"), "doc_id", seed, sample))
    index, value, y = collect_features(labelled_texts(documents, some), GRAMS, "label")
    if len(set(y.tolist())) < 2:
        return None
    late = np.arange(len(y)) % 3 == 2
    early = np.flatnonzero(~late)
    w, b = fit(Rows([index[i] for i in early], [value[i] for i in early], GRAMS.size), y[early], "logistic")
    held = np.flatnonzero(late)
    scores = Rows([index[i] for i in held], [value[i] for i in held], GRAMS.size).dot(w) + b
    return w.astype(np.float32), b, *calibrate(scores, y[held])


def quality(documents: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, the base counts, base_failed, quality (calibrated probability, null without a model), kept."""
    model = train(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        model = shared.value
        for batch in batches:
            docs = texts_of(batch.column(1))
            for i, j in chunks([len(d) for d in docs], 1 << 20):
                base = base_counts(docs[i:j])
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
                if model is None:
                    p, good = pa.nulls(j - i, pa.float64()), ~failed
                else:
                    w, b, a, c = model
                    score = sigmoid(a * (GRAMS.project(docs[i:j], w[:, None])[:, 0] + b) + c)
                    p, good = pa.array(score), ~failed & (score >= keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(base[k]) for k in counts), pa.array(failed), p, pa.array(good)], ["doc_id", *counts, "base_failed", "quality", "kept"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in counts) + ", base_failed boolean, quality double, kept boolean"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
