"""From prompts to model input, and from generated ids to audio files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.audio import as_float
from ..functions.text import batch_name, join_path, output_name
from ..operators.audio import or_silence, peak_normalise
from ..operators.batching import left_pad
from ..operators.extraction import extract_codes
from ..operators.frames import deinterleave
from ..operators.sequences import prompt_sequence, voice_text
from ..session import settled
from ..sources.prompts import split_block

Step = Callable[[DataFrame], DataFrame]


def prompt_batches(
    df: DataFrame, tokenise: Step, batch: str, voice: str = "voice", text: str = "text"
) -> DataFrame:
    """Left-padded prompt rows: ``input_ids`` and ``attention_mask``."""
    named = voice_text(df, voice, text)
    return left_pad(prompt_sequence(tokenise(named)), batch)


def generated_audio(
    df: DataFrame,
    decode: Step,
    ids: str = "ids",
    normalise: bool = False,
    batch: str | None = None,
    row: str | None = None,
) -> DataFrame:
    """Add ``samples``: generated ids through codes and layers to a waveform.

    ``decode`` adds ``samples`` made of ``l1, l2, l3``. A row without codes gets a
    short silence. ``normalise`` scales peaks above 1, as the web route does.
    """
    layers = deinterleave(extract_codes(df, ids, batch, row))
    decoded = decode(layers)
    sounded = or_silence(decoded.withColumn("samples", as_float(F.col("samples"))))
    return peak_normalise(sounded) if normalise else sounded


def name_outputs(
    df: DataFrame, folder: str, idx: str = "idx", prefix: str = "generated_audio"
) -> DataFrame:
    """Add ``path`` of a numbered file in ``folder``."""
    return df.withColumn("path", join_path(folder, output_name(F.col(idx), prefix)))


def line_batch(
    df: DataFrame,
    key: str,
    text: str,
    tokenise: Step,
    generate: Step,
    decode: Step,
    folder: str,
) -> tuple[DataFrame, DataFrame]:
    """One waveform and file path per non-blank line of a multi-line text; and the lines that failed.

    Each line is a prompt of its own, so there is nothing to pad. A line that fails has its number unused, and
    stands among the faults with its ``step`` and ``error``. Everything is written once and then parted, so the models
    meet each line once.
    """
    lines = split_block(df, F.col(text), [key]).withColumn("prompt", F.col("text"))
    generated = _faulted(generate(_faulted(prompt_sequence(tokenise(lines)))))
    spoken = _faulted(generated_audio(generated, decode))
    step = (
        F.when(F.col("text_ids").isNull(), "tokenise")
        .when(F.col("ids").isNull(), "generate")
        .when(F.col("samples").isNull(), "decode")
    )
    name = batch_name(F.col("idx"), F.col("text"))
    inside = F.concat(F.lit(folder.rstrip("/") + "/"), F.col(key).cast("string"))
    done = settled(
        spoken.select(
            key, "idx", "text", join_path(inside, name).alias("path"), "samples", step.alias("step"), "error"
        ),
        "spoken-lines",
    )
    faults = done.filter("step is not null").select(key, "idx", "text", "step", "error")
    return done.filter("step is null").drop("step", "error"), faults


def _faulted(df: DataFrame) -> DataFrame:
    """The row's first fault in ``error``, also when no step reports any."""
    return df if "error" in df.columns else df.withColumn("error", F.lit(None).cast("string"))
