"""Slicing a manifest into training rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.batching import batch_plan
from ..sinks.tables import write_batches


def slice_table(
    df: DataFrame, path: str, order: list[str], size: int = 2000, total_steps: int = 5000
) -> DataFrame:
    """Write the slices under ``path``; give the plan of rounds back."""
    write_batches(df, path, size, *order)
    return batch_plan(df, size, total_steps)
