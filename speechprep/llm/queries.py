"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechprep.llm.common import table
from speechprep.llm.exact_dedup import exact_dedup
from speechprep.llm.language_id import language_id
from speechprep.llm.lexical_search import lexical_search
from speechprep.llm.license_scan import license_scan, notices
from speechprep.llm.mixing import mix_sources
from speechprep.llm.pieces import encode_digest
from speechprep.llm.projections import near_vectors
from speechprep.llm.quality_classifier import quality_classifier
from speechprep.llm.quality_rules import quality_rules
from speechprep.llm.sharding import shard_by_bytes
from speechprep.llm.simhash import hex_digits, simhash_groups
from speechprep.llm.spelling import spelling_groups
from speechprep.llm.token_counts import token_counts


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), notices(spark))


def piece_model() -> bytes:
    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"), piece_model())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=16)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings of three grades: 0 low quality, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_classifier(table(spark, sf_dir, "documents"), graded(table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", "expected_grade", F.get("tail", F.lit(0)).alias("p_good"), F.get("tail", F.lit(1)).alias("p_best"), "selected"
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    return token_counts(table(spark, sf_dir, "documents"), vocabulary)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    number = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3
    # A document without an id is neither learned from nor held out.
    found = language_id(documents, F.coalesce(number != 1, F.lit(False)))
    return found.select("doc_id", F.coalesce(number == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mix_sources(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", "taken")


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_license_scan, op3_sentencepiece, op4_sharding, op5_quality_classifier,
        op6_token_counts, op7_language_id, op8_simhash, op9_quality_rules, op10_mixing, op11_embedding_near_dedup,
        op12_lexical_search, op13_spelling_variants,
    )
}
