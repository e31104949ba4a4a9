"""Prepared tables: reading them, and tables made from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_table(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    split_column: str = "split",
    format: str = "parquet",
) -> DataFrame:
    """A named table and, when asked, one split of it."""
    df = spark.read.format(format).load(path)
    return df if split is None else df.filter(F.col(split_column) == split)


def sample_rate(df: DataFrame, audio: str = "audio", default: int = 24000) -> Column:
    """Each row's own rate, or the default when the table has none."""
    fields = df.schema[audio].dataType.fieldNames() if audio in df.columns else []
    if "sampling_rate" not in fields:
        return F.lit(default)
    return F.coalesce(F.col(f"{audio}.sampling_rate"), F.lit(default))


def rows_to_table(
    df: DataFrame, text: Column, samples: Column, rate: Column
) -> DataFrame:
    """``{text, audio{array, sampling_rate}}`` rows, lazily; nothing is collected."""
    audio = F.struct(
        samples.cast("array<float>").alias("array"),
        rate.cast("int").alias("sampling_rate"),
    )
    return df.select(text.alias("text"), audio.alias("audio"))
