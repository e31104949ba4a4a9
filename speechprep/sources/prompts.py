"""Prompts: from a file, from multi-line text, or the defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_PROMPTS
from ..functions.text import is_blank, strip
from ..operators.rows import row_index
from .manifest import read_lines


def prompt_lines(
    spark: SparkSession, prompt: str | None = None, path: str | None = None
) -> DataFrame:
    """``(prompt_id, text)``: a single prompt, else the file's lines, else the defaults.

    ``prompt_id`` counts prompts from 0 in the order of files and lines.
    """
    if prompt or not path:
        given = enumerate([prompt] if prompt else DEFAULT_PROMPTS)
        return spark.createDataFrame(list(given), "prompt_id long, text string")
    lines = nonblank(read_lines(spark, path).select("file", "pos", strip(F.col("line")).alias("text")))
    return row_index(lines, "file", "pos", name="prompt_id").select("prompt_id", "text")


def split_block(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """One row per non-blank line of a multi-line text; ``idx`` counts those lines."""
    lines = F.filter(
        F.transform(F.split(text, "\n"), strip), lambda line: line != ""
    )
    return df.select(*keep, F.posexplode(lines).alias("idx", "text"))


def nonblank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(~is_blank(F.col(text)))
