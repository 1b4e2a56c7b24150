"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

toxicity -> language ID -> n-gram Jaccard join -> PII -> best-fit packing. All but the last return the columns of documents.
Stages decide row by row: ids may be null or repeated, further columns are carried along. Null and empty texts pass the first stage and
go in the second; empty tables give an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.llm import jaccard, langid, packing, pii, toxicity
from parcelspark.llm.common import discard, materialise, prepare
from parcelspark.llm.queries import CAPACITY, END_ID, pii_key

# Of the winning family's own probability; checked on a fold of the training rows and junk (README).
LEAST_FAMILY_SCORE = 0.72
# Chunks that a worker remembers between packing tasks: none, as workers go on to other stages and would hold the tokenizer there.
KEPT_CHUNKS = 0
# Rows that go to Python at once: executors run one stage after the other, so buffers of all stages add up in them.
ROWS = 250

# Scores of trained models and tokenizer ids are beyond SQL; tests hold the stages against the operators, brute force and junk.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go, each by its own score; labels of the held-out fold take no part."""
    prepare(spark, ROWS)
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), with_row=True)
    return scored.filter("predicted = 0").select("row.*")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a language go: null texts, texts without a letter, or a family probability below LEAST_FAMILY_SCORE."""
    prepare(spark, ROWS)
    found = langid.detect_language(docs, with_row=True)
    return found.filter((F.col("lang_pred") != "und") & (F.col("family_score") >= LEAST_FAMILY_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row of smallest doc_id stays; rows with null or repeated ids go by a key of their own."""
    prepare(spark, ROWS)
    key = f"key_{uuid.uuid4().hex}"
    if docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    else:
        keyed = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    kept = jaccard.jaccard_components(keyed, id_col=key).filter(F.col(key) == F.col("component_id")).select(key)
    return keyed.join(kept, key, "left_semi").drop(key)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows the new text. No row goes."""
    prepare(spark, ROWS)
    findings = f"found_{uuid.uuid4().hex}"
    out = pii.pseudonymise(docs, pii_key(spark), found_col=findings).drop(findings)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*(f"`{c}`" for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    prepare(spark, ROWS)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, END_ID, keep=KEPT_CHUNKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", pseudonymise),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. What a stage kept is deleted when the next has been written, but for the last one's input, which the result reads."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
