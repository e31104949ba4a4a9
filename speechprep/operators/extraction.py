"""Generated token streams: crop, cut, slot check, classify."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import AUDIO_OFFSET, CODEBOOK, FRAME, FRAME_LAYOUT, TEXT_VOCAB_SIZE
from ..constants import control_tokens
from ..functions import codes as fn
from ..functions.slots import in_slot_codes
from ..session import settled
from .once import once


def crop_after_marker(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Keep what follows the last start-of-speech id of each row."""
    marked = once(df, _at=fn.last_marker(F.col(ids)))
    return once(marked, **{ids: fn.after(F.col(ids), F.col("_at"))}).drop("_at")


def batch_crop_positions(
    df: DataFrame, batch: str, row: str, ids: str = "ids"
) -> DataFrame:
    """``(batch, crop_at)``: the marker column of the last row that has a marker.

    ``row`` is the row's number in its batch.
    """
    marked = once(df.select(batch, row, ids), _at=fn.last_marker(F.col(ids)))
    return (
        marked.filter(F.col("_at").isNotNull())
        .groupBy(batch)
        .agg(F.max_by("_at", row).alias("crop_at"))
    )


def crop_batchwise(df: DataFrame, batch: str, row: str, ids: str = "ids") -> DataFrame:
    """Crop every row of a batch at one column, as a padded matrix would be."""
    crops = settled(batch_crop_positions(df, batch, row, ids), "crops")
    joined = df.join(crops, batch, "left")
    return once(joined, **{ids: fn.after(F.col(ids), F.col("crop_at"))}).drop("crop_at")


def cut_at_stop(df: DataFrame, ids: str = "ids") -> DataFrame:
    return once(df, **{ids: fn.before_stop(F.col(ids))})


def extract_codes(
    df: DataFrame,
    ids: str = "ids",
    batch: str | None = None,
    row: str | None = None,
    out: str = "codes",
) -> DataFrame:
    """Add whole frames of relative codes found in each row's stream.

    Rows are cropped each by its own marker. With ``batch`` and ``row`` named, the
    crop is batch-wide.
    """
    cropped = df.withColumn("_ids", F.col(ids))
    if batch is None:
        cropped = crop_after_marker(cropped, "_ids")
    else:
        cropped = crop_batchwise(cropped, batch, row, "_ids")
    found = cut_at_stop(cropped, "_ids").withColumn("_found", in_slot_codes("_ids"))
    return once(found, **{out: fn.whole_frames(F.col("_found"))}).drop("_ids", "_found")


def classify_token(df: DataFrame, token: str = "token") -> DataFrame:
    """Add ``kind, name, slot, layer, code`` of a token id."""
    names = F.broadcast(control_tokens(df.sparkSession).withColumnRenamed("id", token))
    rel = F.col(token) - AUDIO_OFFSET
    audio = (rel >= 0) & (rel < FRAME * CODEBOOK)
    layers = F.array(*[F.lit(layer) for layer, _ in FRAME_LAYOUT])
    named = df.join(names, token, "left")
    kind = (
        F.when(F.col("name").isNotNull(), "control")
        .when(audio, "audio")
        .when((F.col(token) >= 0) & (F.col(token) < TEXT_VOCAB_SIZE), "text")
        .otherwise("unused")
    )
    slot = F.when(audio, F.call_function("div", rel, F.lit(CODEBOOK)).cast("int"))
    return named.withColumns(
        {
            "kind": kind,
            "slot": slot,
            "layer": F.get(layers, slot),
            "code": F.when(audio, (rel % CODEBOOK).cast("int")),
        }
    )
