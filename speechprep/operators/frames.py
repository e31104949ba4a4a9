"""Codec frames: interleave, split back, collapse repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as fn
from .once import once


def interleave(
    df: DataFrame, l1: str = "l1", l2: str = "l2", l3: str = "l3", out: str = "codes"
) -> DataFrame:
    """Add flat token ids made of three layers; null when a layer is too short."""
    return once(df, **{out: fn.interleave(F.col(l1), F.col(l2), F.col(l3))})


def deinterleave(df: DataFrame, codes: str = "codes") -> DataFrame:
    """Add ``l1, l2, l3`` of relative codes."""
    return once(df, **{f"l{n}": fn.layer_of(F.col(codes), n) for n in (1, 2, 3)})


def collapse_frames(
    df: DataFrame, codes: str = "codes", removed: str | None = "removed"
) -> DataFrame:
    """Drop frames that repeat the first code before them; count them in ``removed``."""
    before = fn.frame_count(F.col(codes))
    out = once(df, _frames=before, **{codes: fn.collapse(F.col(codes))})
    if removed:
        after = fn.frame_count(F.col(codes))
        out = out.withColumn(removed, F.col("_frames") - after)
    return out.drop("_frames")


def explode_frames(df: DataFrame, row: str, codes: str = "codes") -> DataFrame:
    """``(row, frame, c0..c6)``: the long form of flat codes."""
    frames = F.transform(
        F.when(
            F.size(codes) > 0, F.sequence(F.lit(0), fn.frame_count(F.col(codes)) - 1)
        ),
        lambda i: F.struct(
            *[F.get(F.col(codes), 7 * i + k).alias(f"c{k}") for k in range(7)]
        ),
    )
    return df.select(row, F.posexplode(frames).alias("frame", "_f")).select(
        row, "frame", "_f.*"
    )


def frame_runs(
    df: DataFrame,
    row: str,
    frame: str = "frame",
    first: str = "c0",
    stretch: int = 100_000,
) -> DataFrame:
    """Collapse repeats in long form, however many frames one row may have.

    Frames of a row are dealt to stretches of positions, and the last frame of each
    stretch is lent to the next one that has frames. So a window never covers more
    than a stretch, and a row that holds most of the table is worked on in parallel.
    Frame numbers may start anywhere and have gaps; a null code is a code of its own.
    """
    dealt = df.withColumn("_stretch", F.floor(F.col(frame) / stretch))
    code = F.struct(F.col(first).alias("c"))
    lasts = dealt.groupBy(row, "_stretch").agg(F.max_by(code, frame).alias("_last"))
    lent = lasts.select(
        F.col(row).alias("_row"),
        F.col("_stretch").alias("_at"),
        F.lag("_last").over(Window.partitionBy(row).orderBy("_stretch")).alias("_lent"),
    )
    inside = F.lag(code).over(Window.partitionBy(row, "_stretch").orderBy(frame))
    placed = dealt.withColumn("_inside", inside)
    same = F.col(row).eqNullSafe(F.col("_row")) & (F.col("_stretch") == F.col("_at"))
    before = F.coalesce("_inside", "_lent")
    return (
        placed.join(lent, same)
        .filter(before.isNull() | ~F.col(first).eqNullSafe(before["c"]))
        .select(*df.columns)
    )
