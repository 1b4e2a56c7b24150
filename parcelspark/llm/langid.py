"""Hierarchical language identification: the family first, then one-versus-one linear SVMs inside it.

Features are hashed character n-grams. At most ``SAMPLE`` labelled texts of each language (least keyed hash) train
the models; a third of them calibrates the margins. A language without a listed family is a family of its own. Null and empty texts and
texts without a letter (Unicode category L) are ``und`` with score 0, as is everything when no language can be learned. Long texts are
scored a window at a time. Ids are only carried: repeated rows have equal results, a row with a null id is scored but never
learned from, and of a repeated id one text, the least, is learned from. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from parcelspark.llm.common import chunks, fold, texts_of, trim
from parcelspark.llm.linear import CHUNK, Ngrams, Rows, calibrate, collect_features, fit, sigmoid

SAMPLE = 500
GRAMS = Ngrams(words=(), chars=(2, 3, 4), bits=16)
# Families of common ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl sv da no is",
    "romance": "fr es it pt ro ca",
    "slavic": "ru pl cs uk bg sk sr hr sl",
}
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs.split()), lang)


def _model(index, value, positive: np.ndarray, late: np.ndarray, loss: str):
    """(weights, bias, a, c): fitted to the early rows, calibrated on the late ones."""
    early, held = np.flatnonzero(~late), np.flatnonzero(late)
    w, b = fit(Rows([index[i] for i in early], [value[i] for i in early], GRAMS.size), positive[early], loss, steps=60)
    s = Rows([index[i] for i in held], [value[i] for i in held], GRAMS.size).dot(w) + b
    return w.astype(np.float32), b, *calibrate(s, positive[held])


def train(labelled: DataFrame, sample: int = SAMPLE, seed: int = 3) -> dict:
    """labelled: doc_id, text, lang. Languages, family models (one against the rest) and pair models."""
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    # Numbered within each language over a hash range that shrinks the candidates first, so no task gathers a language.
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 2 * sample / n)))]) if sizes else None
    if not sizes:
        return {"langs": []}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    near = known.select("doc_id", "lang").filter(draw < share[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id"))
    some = near.withColumn("r", rank).filter(F.col("r") <= sample).select("doc_id").distinct()
    texts = known.join(F.broadcast(some.limit(sample * len(sizes))), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x")).select("doc_id", "x.text", "x.lang")
    index, value, lang = collect_features(texts, GRAMS, "lang")
    langs = sorted(set(lang.tolist()))
    family = np.array([family_of(x) for x in lang])
    late = np.arange(len(lang)) % 3 == 2
    families = sorted(set(family.tolist()))
    out = {"langs": langs, "families": families, "first": [], "pairs": []}
    if len(families) > 1:
        out["first"] = [_model(index, value, (family == f).astype(int), late, "hinge") for f in families]
    for f in families:
        for x, y in combinations([k for k in langs if family_of(k) == f], 2):
            at = np.flatnonzero((lang == x) | (lang == y))
            out["pairs"].append((f, x, y, _model([index[i] for i in at], [value[i] for i in at], (lang[at] == x).astype(int), late[at], "hinge")))
    del index, value, texts
    trim()
    return out


def identify(texts: list[str | None], docs: list[bytes], model: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score (family share times the mean of the winner's pair probabilities) and the family's own one-against-rest probability of each text."""
    if not model["langs"]:
        return ["und"] * len(docs), np.zeros(len(docs)), np.zeros(len(docs))
    every = [*model["first"], *(p[3] for p in model["pairs"])]
    if every:
        z = GRAMS.project(docs, np.stack([m[0] for m in every], 1)) + np.array([m[1] for m in every])
        p = sigmoid(z * np.array([m[2] for m in every]) + np.array([m[3] for m in every]))
    k = len(model["first"])
    names, scores, own = [], np.zeros(len(docs)), np.zeros(len(docs))
    members = {f: [x for x in model["langs"] if family_of(x) == f] for f in model["families"]}
    for i, text in enumerate(texts):
        if not text or not _LETTER.search(text):
            names.append("und")
            continue
        f = model["families"][int(np.argmax(p[i, :k]))] if k else model["families"][0]
        score = p[i, :k].max() / p[i, :k].sum() if k else 1.0
        if len(members[f]) > 1:
            won = {x: [] for x in members[f]}
            for j, (g, x, y, _) in enumerate(model["pairs"]):
                if g == f:
                    won[x].append(p[i, k + j])
                    won[y].append(1 - p[i, k + j])
            best = max(members[f], key=lambda x: (sum(v > 0.5 for v in won[x]), sum(won[x])))
            score *= sum(won[best]) / len(won[best])
        else:
            best = members[f][0]
        names.append(best)
        scores[i] = score
        own[i] = p[i, :k].max() if k else 1.0
    return names, scores, own


def detect_language(documents: DataFrame, modulus: int = 4, held: int = 2, with_row: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, family_score; ``with_row`` adds row, a struct of all columns. Learns from rows whose fold is not ``held``."""
    model = train(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(fold("doc_id", modulus) != held))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            column = b.column(1).field("text")
            docs, texts = texts_of(column), column.to_pylist()
            for i, j in chunks([len(d) for d in docs], CHUNK):
                names, scores, own = identify(texts[i:j], docs[i:j], shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(scores), pa.array(own), *([b.column(1).slice(i, j - i)] if with_row else [])], ["doc_id", "lang_pred", "score", "family_score", *(["row"] if with_row else [])])
        trim()

    some = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*" if with_row else "text").alias("row"))
    schema = StructType.fromDDL("doc_id long, lang_pred string, score double, family_score double")
    out = some.mapInArrow(run, StructType([*schema, *(some.schema[1:] if with_row else [])]))
    return out.select("doc_id", (fold("doc_id", modulus) == held).alias("held_out"), "lang_pred", "score", "family_score", *(["row"] if with_row else []))
