"""Waveform arrays as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SILENT_SAMPLES


def as_float(samples: Column) -> Column:
    return samples.cast("array<float>")


def first_channel(channels: Column) -> Column:
    return F.get(channels, 0)


def peak(samples: Column) -> Column:
    """Largest magnitude."""
    return F.greatest(F.array_max(samples), -F.array_min(samples))


def scaled_by(samples: Column, top: Column) -> Column:
    """Divide by the peak when it passes 1; ``top`` must be a plain column."""
    return F.when(
        top > 1, F.transform(samples, lambda v: (v / top).cast("float"))
    ).otherwise(samples)


def silence(samples: int = SILENT_SAMPLES) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), samples)
