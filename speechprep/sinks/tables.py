"""Table writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.batching import assign_batches
from ..operators.rows import keep_columns


def write_batches(
    df: DataFrame, path: str, size: int = 2000, *order: str, format: str = "csv"
) -> None:
    """Consecutive slices of the table, a folder ``batch_id=k`` with one file for each.

    The rows are numbered, and every slice, ``size`` rows by its numbers, goes whole to one task, which
    writes it in order; the file holds the columns of the table only. Tasks get as many slices as the shuffle's partitions
    give them, so slices are also spread evenly however the table was.
    """
    sliced = assign_batches(df, size, *order).repartition("batch_id")
    writer = sliced.sortWithinPartitions("batch_id", "idx").drop("idx").write.partitionBy("batch_id")
    if format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(format).save(path)


def write_training_table(df: DataFrame, path: str) -> None:
    keep_columns(df).write.parquet(path)


def export_manifest(written: DataFrame) -> DataFrame:
    """Base names of the files that were written; no row when none was."""
    return written.filter("ok").select(
        F.substring_index("path", "/", -1).alias("file_name")
    )
