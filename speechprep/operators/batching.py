"""Batches: slices of a table, padding to the longest row, generation settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BASE_SETTINGS, LABEL_PAD, PAD, SETTINGS
from ..constants import presets as preset_table
from ..functions import sequences as fn
from ..session import settled
from .once import once
from .rows import row_index

COLLATED = {"input_ids": PAD, "attention_mask": 0, "labels": LABEL_PAD}
SEQUENCE_CHUNK = 65_536


def assign_batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Add ``idx`` and ``batch_id``: consecutive slices of ``size`` rows in order."""
    indexed = row_index(df, *order)
    return indexed.withColumn("batch_id", F.call_function("div", "idx", F.lit(size)))


def batch_plan(df: DataFrame, size: int = 2000, total_steps: int = 5000) -> DataFrame:
    """One row per slice: its bounds, its size and its share of the steps.

    Follows from the row count alone, so no row is moved.
    """
    div = lambda a, b: F.call_function("div", a, b)
    n, total = F.col("n"), F.col("total_batches")
    plan = df.agg(F.count("*").alias("n")).select(
        "n", div(F.col("n") + (size - 1), F.lit(size)).alias("total_batches")
    )
    # Slice numbers are made in chunks, so that no array grows with the table.
    last = div(total - 1, F.lit(SEQUENCE_CHUNK))
    chunked = plan.filter(total > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last))
    )
    first = F.col("_chunk") * SEQUENCE_CHUNK
    numbered = chunked.withColumn(
        "batch_id",
        F.explode(F.sequence(first, F.least(first + SEQUENCE_CHUNK, total) - 1)),
    )
    start = F.col("batch_id") * size
    end = F.least(start + size, n)
    steps = div(F.lit(total_steps).cast("long"), total)
    return numbered.select(
        "batch_id",
        start.alias("start"),
        end.alias("end"),
        (end - start).alias("size"),
        "total_batches",
        steps.alias("steps_per_batch"),
        div(steps, F.lit(4)).alias("save_steps"),
    )


def batch_max_len(df: DataFrame, batch: str, values: str) -> DataFrame:
    """``(batch, max_len)``; counted where the rows are, then combined."""
    return df.groupBy(batch).agg(F.max(F.size(values)).alias("max_len"))


def pad(
    df: DataFrame,
    batch: str,
    cols: dict[str, int] = COLLATED,
    side: str = "right",
) -> DataFrame:
    """Pad arrays to the longest row of their batch, each with its own fill value.

    The rows are written once, with their lengths, so costly or random input is evaluated once. The widths
    are joined back rather than taken from a window: with few batches they are broadcast and no row moves;
    with many, a batch that holds most of the rows is split by the adaptive skew join.
    """
    lead = next(iter(cols))
    rows = settled(df.withColumn("_length", F.size(lead)), "unpadded")
    widths = settled(rows.groupBy(batch).agg(F.max("_length").alias("max_len")), "widths")
    padded = {
        c: fn.padded(F.col(c), fill, F.col("max_len"), side) for c, fill in cols.items()
    }
    return once(rows.drop("_length").join(widths, batch), **padded).drop("max_len")


def left_pad(df: DataFrame, batch: str, ids: str = "input_ids") -> DataFrame:
    """Prompt matrix rows: pad id and mask 0 in front, mask 1 over the prompt."""
    masked = once(df, attention_mask=fn.ones(F.col(ids)))
    return pad(masked, batch, {ids: PAD, "attention_mask": 0}, side="left")


def collate(df: DataFrame, batch: str, side: str = "right") -> DataFrame:
    """Training matrix rows: ids, mask and labels padded together."""
    return pad(df, batch, COLLATED, side)


def resolve_params(
    df: DataFrame,
    presets: DataFrame | None = None,
    base: dict[str, float] = BASE_SETTINGS,
) -> DataFrame:
    """Settings of each prompt: its own value, else its preset's, else the base.

    The built-in presets are three rows and are broadcast; a table handed in is
    joined as Spark sees fit.
    """
    table = F.broadcast(preset_table(df.sparkSession)) if presets is None else presets
    table = table.withColumnsRenamed({s: f"_{s}" for s in SETTINGS})
    own = [s for s in SETTINGS if s in df.columns]
    joined = df.join(table, "preset", "left")
    values = {}
    for s in SETTINGS:
        choices = [F.col(s)] if s in own else []
        kind = "int" if isinstance(base[s], int) else "double"
        values[s] = F.coalesce(*choices, F.col(f"_{s}"), F.lit(base[s])).cast(kind)
    return joined.withColumns(values).drop(*[f"_{s}" for s in SETTINGS])
