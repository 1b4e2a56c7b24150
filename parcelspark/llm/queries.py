"""One query for each operator, with production parameters over its whole table."""

from __future__ import annotations

import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parcelspark.llm import ann, bpe, collocations, common, divergence, jaccard, langid, lm, packing, pii, pu, quality, shards, toxicity

ORDER_KEY = "parcelspark-order-key"
CAPACITY, END_ID = 4096, 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pii_key(spark: SparkSession) -> str:
    """The secret key of the pseudonyms: ``spark.parcelspark.pii.key``, or where it is unset a random one for the session, so its pseudonyms can't be traced back."""
    key = spark.conf.get("spark.parcelspark.pii.key", None)
    if key is None:
        key = secrets.token_hex(32)
        spark.conf.set("spark.parcelspark.pii.key", key)
    return key


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), CAPACITY, END_ID)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.scratch_path(spark, "shards")
    return shards.materialise_training_order(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ORDER_KEY)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect_language(table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_lm_scoring, op4_best_fit_packing, op5_pii, op6_ngram_jaccard_join, op7_nearest_neighbours, op8_byte_bpe, op9_training_order, op10_language_id, op11_quality_classifier, op12_source_divergence, op13_phrase_collocations)}

# Whole-text SQL exists for none of the learned, tokenised or searched results; op6 is checked by tests against brute force.
ORACLE: dict[str, str] = {"op12_source_divergence": divergence.AUDIT_SQL, "op13_phrase_collocations": collocations.mine_sql()}
