"""One WAV file per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SAMPLE_RATE
from ..functions import wav
from ..functions.files import write_bytes
from ..operators.models import pieces


def wav_writer(rate: int = SAMPLE_RATE, encoding: str = "float32"):
    """Column UDF: path and samples -> ``(ok, error)`` after writing the file.

    A row that fails is reported; the others go on.
    """

    def matrix(samples) -> np.ndarray:
        """(channel, time), for one waveform or a list of channels."""
        nested = len(samples) and np.ndim(samples[0]) == 1
        return np.stack(list(samples)) if nested else np.asarray(samples)

    def one(path: str, samples) -> tuple[bool, str | None]:
        try:
            if samples is None:
                raise ValueError("no samples")
            write_bytes(path, wav.write_wav(matrix(samples), rate, encoding))
            return True, None
        except Exception as fault:
            return False, str(fault) or type(fault).__name__

    def rows(path: pa.Array, samples: pa.Array) -> Iterator[tuple]:
        for some in pieces((path, samples)):
            names, sounds = (column.to_pandas() for column in some)
            yield from zip(names, sounds)

    @F.arrow_udf("ok boolean, error string")
    def write(path: pa.Array, samples: pa.Array) -> pa.Array:
        done = [one(p, s) for p, s in rows(path, samples)]
        columns = [pa.array([ok for ok, _ in done], pa.bool_()), pa.array([error for _, error in done], pa.string())]
        return pa.StructArray.from_arrays(columns, ["ok", "error"])

    # Writing is an effect: Spark must not run it twice or leave it out.
    return write.asNondeterministic()


def write_wavs(
    df: DataFrame,
    path: str = "path",
    samples: str = "samples",
    rate: int = SAMPLE_RATE,
    encoding: str = "float32",
) -> DataFrame:
    """``(keep.., path, ok, error)``: files are written when this is evaluated."""
    write = wav_writer(rate, encoding)
    out = df.withColumn("_written", write(F.col(path), F.col(samples)))
    return out.select("*", "_written.*").drop("_written", samples)
