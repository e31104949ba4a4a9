"""Waveform operators on array columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import audio as fn
from .once import once


def peak_normalise(df: DataFrame, samples: str = "samples") -> DataFrame:
    """Divide a waveform by its peak when the peak passes 1."""
    # The peak is its own column, or the lambda would look for it at every sample.
    topped = once(df, _top=fn.peak(F.col(samples)))
    scaled = fn.scaled_by(F.col(samples), F.col("_top"))
    return once(topped, **{samples: scaled}).drop("_top")


def or_silence(df: DataFrame, codes: str = "codes", samples: str = "samples") -> DataFrame:
    """A short stretch of zeros where a row has no codes."""
    return df.withColumn(
        samples, F.when(F.size(codes) == 0, fn.silence()).otherwise(F.col(samples))
    )
