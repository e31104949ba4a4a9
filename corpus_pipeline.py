"""From raw documents to encoded training text, in five stages over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from speechprep.llm.common import table
from speechprep.llm.exact_dedup import drop_exact_copies
from speechprep.llm.mixing import mixed
from speechprep.llm.pieces import encode_digest
from speechprep.llm.quality_classifier import select_quality
from speechprep.llm.queries import graded, piece_model
from speechprep.llm.simhash import drop_near_copies
from speechprep.session import settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably better than the lowest grade."""
    return select_quality(docs, graded(table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints over 4-word shingles link within 4 bits."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each document: their ids, number, a checksum, and whether they decode to the text."""
    return encode_digest(docs, piece_model())


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Fitted weights, fingerprints and the lattice are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
