"""From manifests or prepared tables to training sequences."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import AUDIT_TEXTS, SAMPLE_RATE, TRAINING_COLUMNS
from ..functions.text import join_path, plain_path
from ..operators.frames import collapse_frames, interleave
from ..operators.funnel import Funnel, passing
from ..operators.models import apply_encoder, apply_model
from ..operators.rows import cap_rows, has_codes, keep_columns
from ..operators.sequences import speaker_text, train_sequence
from ..operators.vocab import audit_sample, vocab_coverage
from ..session import settled
from ..sources.audio_files import CODED, FILES_AT_ONCE, from_path, from_samples, sized
from ..sources.manifest import MISSING_FILE
from ..sources.tables import sample_rate

Step = Callable[[DataFrame], DataFrame]


def encode_files(
    encoder, rate: int = SAMPLE_RATE, on_error: str = "silence", budget: int | None = None
) -> Step:
    """Step that adds ``codes`` of the file at each row's ``path``, read on demand, ``decode_ok`` and ``error``.

    An unreadable file is coded as silence, or gives null codes with any other ``on_error``; either way
    ``decode_ok`` is false and ``error`` says why. With a ``budget`` the encoder takes lists of waveforms, as many as hold
    so many samples when padded to the longest.
    """

    def step(df: DataFrame) -> DataFrame:
        files = None if budget is None else FILES_AT_ONCE
        factory = from_path(encoder, rate, on_error, budget)
        coded = apply_model(df, factory, ["path"], "_coded", CODED, budget=files, cost=lambda row: 1)
        return coded.withColumns(
            {
                "codes": F.col("_coded.codes"),
                "error": F.coalesce("error", "_coded.fault"),
                "decode_ok": F.col("_coded.fault").isNull(),
            }
        ).drop("_coded")

    return step


def encode_samples(encoder, rate: int = SAMPLE_RATE) -> Step:
    """Step that adds ``codes`` of each row's ``audio``, by the row's own rate."""

    def step(df: DataFrame) -> DataFrame:
        rows = df.withColumns(
            {"_samples": F.col("audio.array"), "_rate": sample_rate(df, default=rate)}
        ).drop("audio")
        coded = apply_encoder(rows, from_samples(encoder, rate), "_samples", "_rate")
        return interleave(coded).drop("l1", "l2", "l3", "_samples", "_rate")

    return step


def prepare_table(df: DataFrame, encode: Step, tokenise: Step) -> DataFrame:
    """Training rows of a table with text and audio.

    ``encode`` adds ``codes`` (null for a failed row); ``tokenise`` adds
    ``text_ids`` made of ``prompt`` (null for a failed row). Rows without either are left out. Both stay in the row's own
    task, so nothing is shuffled here.
    """
    valid = has_codes(encode(df))
    unlike = has_codes(collapse_frames(valid, removed=None))
    named = tokenise(speaker_text(unlike)).filter(F.col("text_ids").isNotNull())
    return keep_columns(train_sequence(named))


def located(rows: DataFrame, audio_dir: str) -> DataFrame:
    """Add ``path`` of each row's audio, named as the inventory names it."""
    return rows.withColumn("path", plain_path(join_path(audio_dir, F.col("audio"))))


def manifest_rows(
    rows: DataFrame,
    inventory: DataFrame | None = None,
    audio_dir: str = "",
    max_samples: int | None = None,
) -> DataFrame:
    """``(file, pos, path, text)`` of capped manifest rows whose file exists.

    The cap comes before the check, so missing files take places under the cap.
    Without an inventory each row asks for its own file.
    """
    found = looked_up(cap_rows(rows, max_samples, "file", "pos"), inventory, audio_dir)
    return found.filter("found").drop("found")


def looked_up(rows: DataFrame, inventory: DataFrame | None, audio_dir: str = "") -> DataFrame:
    """Add ``path`` of each row's audio, and ``found``: whether the file is there."""
    placed = located(rows, audio_dir).drop("audio")
    if inventory is None:
        return sized(placed).withColumn("found", F.col("length").isNotNull()).drop("length")
    known = inventory.select("path").distinct().withColumn("found", F.lit(True))
    return placed.join(known, "path", "left").withColumn("found", F.col("found").isNotNull())


class Prepared(NamedTuple):
    """Training rows, what went wrong on the way, and how many rows passed each stage."""

    rows: DataFrame
    faults: DataFrame
    funnel: dict[str, int]


#: Steps a row can fail at, in order.
FIND, DECODE, ENCODE, COLLAPSE, TOKENISE = "find", "decode", "encode", "collapse", "tokenise"


def prepare_manifest(
    rows: DataFrame,
    inventory: DataFrame | None,
    encode: Step,
    tokenise: Step,
    audio_dir: str = "",
    max_samples: int | None = None,
) -> Prepared:
    """Training rows of a manifest; only paths travel until ``encode`` reads audio.

    Two tables are written, and counted while they are: the rows with whether their file is there, and what
    became of those that have one. So ``encode`` and ``tokenise`` meet each found row once. ``faults`` has
    ``file, pos, path, text``, the ``step`` a row failed at, ``error``, and ``trained``: an unreadable file that is coded as
    silence is a fault whose row is trained on. ``encode`` and ``tokenise`` may add ``error``, ``encode`` may add ``decode_ok``.
    """
    counts = Funnel()
    capped = cap_rows(rows, max_samples, "file", "pos").select("file", "pos", "audio", "text")
    looked = looked_up(capped, inventory, audio_dir)
    looked = settled(
        counts.watch(looked, **passing(manifest_rows=F.lit(True), audio_found=F.col("found"))), "located"
    )
    coded = _with_missing(encode(looked.filter("found").drop("found")), decode_ok="boolean", error="string")
    whole = coded.withColumns({"_null": F.col("codes").isNull(), "_empty": F.size("codes") == 0})
    unlike = speaker_text(collapse_frames(whole, removed=None)).withColumnRenamed("error", "_fault")
    named = _with_missing(tokenise(unlike), error="string").withColumn("error", F.coalesce("_fault", "error"))
    step = (
        F.when(F.col("_null"), F.when(~F.col("decode_ok"), DECODE).otherwise(ENCODE))
        .when(F.col("_empty"), ENCODE)
        .when(F.col("codes").isNull() | (F.size("codes") == 0), COLLAPSE)
        .when(F.col("text_ids").isNull(), TOKENISE)
    )
    marked = named.withColumn("_lost", step)
    built = train_sequence(marked).withColumn(
        "step", F.coalesce("_lost", F.when(~F.col("decode_ok"), DECODE))
    )
    lost = F.coalesce("_lost", F.lit(""))
    stages = passing(
        codes_not_null=~F.col("_null"),
        codes_not_empty=~F.col("_empty"),
        frames_left=lost != COLLAPSE,
        text_ids_not_null=lost != TOKENISE,
    )
    undecodable = F.count_if(~F.coalesce("decode_ok", F.lit(True)))
    failed = F.count_if(F.col("_lost").isNotNull())
    prepared = settled(
        counts.watch(built, **stages, undecodable=undecodable, failed_rows=failed).select(
            "file", "pos", "path", "text", "step", "error", F.col("_lost").isNull().alias("trained"),
            *TRAINING_COLUMNS,
        ),
        "prepared",
    )
    told = ["file", "pos", "path", "text", "step", "error", "trained"]
    missing = looked.filter(~F.col("found")).select(
        "file", "pos", "path", "text", F.lit(FIND).alias("step"), F.lit(MISSING_FILE).alias("error"),
        F.lit(False).alias("trained"),
    )
    faults = prepared.filter("step is not null").select(*told).unionByName(missing)
    return Prepared(keep_columns(prepared.filter("trained")), faults, counts.counts())


def _with_missing(df: DataFrame, **columns: str) -> DataFrame:
    """Add null columns that a step did not."""
    return df.withColumns({n: F.lit(None).cast(kind) for n, kind in columns.items() if n not in df.columns})


def audit(
    rows: DataFrame, vocab: DataFrame, max_samples: int | None = None, n: int | None = AUDIT_TEXTS
) -> DataFrame:
    """Vocabulary coverage of the first ``n`` texts under the cap, or of all with ``None``."""
    capped = cap_rows(rows, max_samples, "file", "pos")
    return vocab_coverage(audit_sample(capped, "file", "pos", n=n), vocab)


def stage_funnel(
    rows: DataFrame, inventory: DataFrame | None, encode: Step, audio_dir: str = ""
) -> DataFrame:
    """How many manifest rows pass each stage, in one row; only rows with a file are encoded, each once.

    ``prepare_manifest`` counts the same while it works. This runs when called.
    """
    counts = Funnel()
    looked = settled(
        counts.watch(
            looked_up(rows.select("file", "pos", "audio", "text"), inventory, audio_dir),
            **passing(manifest_rows=F.lit(True), audio_found=F.col("found")),
        ),
        "located",
    )
    coded = encode(looked.filter("found").drop("found"))
    unlike = collapse_frames(coded.withColumn("_unlike", F.col("codes")), "_unlike")
    stages = passing(
        codes_not_null=F.col("codes").isNotNull(),
        codes_not_empty=F.size("codes") > 0,
        frames_left=F.size("_unlike") > 0,
    )
    passed = unlike.agg(*[count.alias(stage) for stage, count in stages.items()]).first()
    row = counts.counts() | passed.asDict()
    return rows.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{name} long" for name in row))
