"""Training and prompt sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as fn
from ..functions.text import speaker_prefix, voice_prefix
from .once import once


def speaker_text(df: DataFrame, text: str = "text", out: str = "prompt") -> DataFrame:
    """``source: text`` when the table has a ``source`` column, else the text."""
    if "source" in df.columns:
        return df.withColumn(out, speaker_prefix(F.col("source"), F.col(text)))
    return df.withColumn(out, F.col(text))


def voice_text(
    df: DataFrame, voice: str = "voice", text: str = "text", out: str = "prompt"
) -> DataFrame:
    return df.withColumn(out, voice_prefix(F.col(voice), F.col(text)))


def train_sequence(
    df: DataFrame, text_ids: str = "text_ids", codes: str = "codes"
) -> DataFrame:
    """Add ``input_ids``, ``labels`` (the same) and ``attention_mask`` (ones)."""
    built = once(df, input_ids=fn.training_ids(F.col(text_ids), F.col(codes)))
    return built.withColumns(
        {"labels": F.col("input_ids"), "attention_mask": fn.ones(F.col("input_ids"))}
    )


def prompt_sequence(df: DataFrame, text_ids: str = "text_ids") -> DataFrame:
    return once(df, input_ids=fn.prompt_ids(F.col(text_ids)))
