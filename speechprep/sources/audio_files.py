"""Audio files: inventory, decoding a folder, late loading by path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import SAMPLE_RATE
from ..functions import wav
from ..functions.codes import interleaved
from ..functions.files import file_size, list_folder, read_bytes
from ..operators.models import batched_calls
from ..session import settled

# Bytes of audio that one Arrow batch may hold when rows are made from paths.
CHUNK_BYTES = 64 << 20
# Bytes of files that a task decodes, about.
TASK_BYTES = 128 << 20
# Files that an encoder with a budget has open at once.
FILES_AT_ONCE = 64
LISTED = 10_000
DECODED = "samples array<float>, source_rate int, decode_ok boolean, error string"
CODED = "struct<codes: array<int>, fault: string>"


def audio_inventory(spark: SparkSession, *folders: str) -> DataFrame:
    """``(path, length, modificationTime)`` of all files in and below the folders; contents stay unread.

    Folders are listed by tasks, round after round: what a round finds is a table, whose folders are the next
    round's. The driver only learns whether there are more. Names are as they are (``_x.wav`` and ``.x.wav`` too);
    local ones are without ``file:``, as ``plain_path`` names them. Links to folders are not followed.
    """

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for some in list_folder(folder, LISTED):
                    yield pa.RecordBatch.from_pylist(some, shape)

    kinds = {"path": pa.string(), "length": pa.int64(), "modificationTime": pa.timestamp("us", "UTC"), "folder": pa.bool_()}
    shape = pa.schema(list(kinds.items()))
    tasks = 4 * spark.sparkContext.defaultParallelism
    plain = ["/" + f.removeprefix("file:").lstrip("/") if f.startswith("file:") else f for f in folders]
    front = spark.createDataFrame([(f,) for f in plain], "path string")
    found = None
    while True:
        listed = settled(
            front.repartition(tasks, "path").mapInArrow(
                listing, "path string, length long, modificationTime timestamp, folder boolean"
            ),
            "listed",
        )
        files = listed.filter("not folder").drop("folder")
        found = files if found is None else found.unionByName(files)
        front = listed.filter("folder").select("path")
        if front.isEmpty():
            return found


@F.arrow_udf(T.LongType())
def length_at(path: pa.Array) -> pa.Array:
    """Size of the file at each path, asked for in the row's own task; null if none."""
    names = path.to_pylist()
    return pa.array([None if n is None else file_size(n) for n in names], pa.int64())


def sized(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``length`` of each row's file; null when it is missing.

    Unlike an inventory this lists no folder, so no file list grows on the driver.
    """
    return df.withColumn("length", length_at(F.col(path)))


def waveform(content: bytes, rate: int) -> tuple[np.ndarray, int]:
    """Mono samples at ``rate``, and the rate they had in the file."""
    channels, source_rate = wav.read_wav(content)
    samples = wav.resample(wav.mono(channels), source_rate, rate)
    if not len(samples):
        raise ValueError("no samples")
    return samples, source_rate


def _decoded(read, rate: int, on_error: str) -> tuple:
    """What ``read()`` gives, decoded: samples, source rate, whether that worked, and the fault."""
    try:
        content = read()
        if content is None:
            raise FileNotFoundError("no such file")
        return *waveform(content, rate), True, None
    except Exception as fault:
        empty = np.zeros(rate, np.float32) if on_error == "silence" else None
        return empty, None, False, str(fault) or type(fault).__name__


_KINDS = [pa.list_(pa.float32()), pa.int32(), pa.bool_(), pa.string()]


def _by_bytes(rows: Iterator[tuple], end: int) -> Iterator[tuple[int, list[pa.Array]]]:
    """Decoded rows as Arrow columns, and how many, whenever they hold a chunk of samples."""
    done, held = [], 0
    for at, row in enumerate(rows, 1):
        done.append(row)
        held += 0 if row[0] is None else row[0].nbytes
        if held >= CHUNK_BYTES or at == end:
            yield len(done), [pa.array(column, kind) for column, kind in zip(zip(*done), _KINDS)]
            done, held = [], 0


def decoder(rate: int = SAMPLE_RATE, on_error: str = "silence"):
    """Column UDF: file bytes -> mono samples at ``rate``.

    A missing, empty or undecodable file gives one second of zeros and
    ``decode_ok = false``, or null samples with ``on_error="null"``.
    """
    names = [part.split()[0] for part in DECODED.split(", ")]

    @F.arrow_udf(DECODED)
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = (_decoded(content.as_py, rate, on_error) for content in batch)
            for _, columns in _by_bytes(rows, len(batch)):
                yield pa.StructArray.from_arrays(columns, names)

    # Not deterministic: a filter on decode_ok must not decode once more.
    return decode.asNondeterministic()


def from_path(encoder, rate: int = SAMPLE_RATE, on_error: str = "silence", budget: int | None = None):
    """Factory of an encoder that takes a path: read, decode and encode in one go.

    Neither bytes nor samples leave the Python worker; only flat codes do (as ``interleave`` makes them), with the ``fault`` of a file that was
    coded as silence. With a ``budget`` it takes a list of rows, and the encoder lists of waveforms.
    """

    def heard(path: str) -> tuple[np.ndarray | None, str | None]:
        samples, _, _, fault = _decoded(lambda: read_bytes(path), rate, on_error)
        return samples, fault

    def coded(layers, fault: str | None) -> dict:
        named = layers if isinstance(layers, dict) else dict(zip(("l1", "l2", "l3"), layers or (None,) * 3))
        return {"codes": interleaved(*[named.get(n) for n in ("l1", "l2", "l3")]), "fault": fault}

    def build():
        encode = encoder()

        def one(path: str) -> dict:
            samples, fault = heard(path)
            return coded(None if samples is None else encode(samples), fault)

        def many(rows: list[tuple]) -> list:
            sounds = [heard(path) for (path,) in rows]
            out: list = [coded(None, fault) for _, fault in sounds]
            there = [k for k, (samples, _) in enumerate(sounds) if samples is not None]
            call = batched_calls(lambda some: encode([x for (x,) in some]), None, budget, lambda row: len(row[0]))
            for k, (layers, error) in zip(there, call([(sounds[k][0],) for k in there])):
                out[k] = ValueError(error) if error else coded(layers, sounds[k][1])
            return out

        return one if budget is None else many

    return build


def from_samples(encoder, rate: int = SAMPLE_RATE):
    """Factory of an encoder that takes samples and the rate of their row."""

    def build():
        encode = encoder()
        return lambda samples, own: encode(
            wav.resample(np.asarray(samples, np.float32), int(own), rate)
        )

    return build


def decode_audio(
    spark: SparkSession, path: str, rate: int = SAMPLE_RATE, on_error: str = "silence"
) -> DataFrame:
    """``(path, samples, source_rate, decode_ok, error)`` for a folder of files.

    The files are dealt to tasks of about TASK_BYTES each, by their known sizes.
    """
    files = audio_inventory(spark, path)
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return decode_paths(files.select("path").repartition(tasks), rate=rate, on_error=on_error)


def decode_paths(
    df: DataFrame, path: str = "path", rate: int = SAMPLE_RATE, on_error: str = "silence"
) -> DataFrame:
    """Add the decoder's columns for the file at each row's path; ``on_error="drop"`` leaves faulty rows out.

    A task opens one file after the other, and rows leave it as soon as they hold a chunk of samples.
    """
    schema = T.StructType([*df.schema, *T.StructType.fromDDL(DECODED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(path).to_pylist()
            kind = "null" if on_error == "drop" else on_error
            rows = (_decoded(lambda n=n: None if n is None else read_bytes(n), rate, kind) for n in names)
            start = 0
            for count, columns in _by_bytes(rows, len(names)):
                own = batch.slice(start, count).columns
                yield pa.RecordBatch.from_arrays([*own, *columns], schema.names)
                start += count

    out = df.mapInArrow(run, schema)
    return out.filter("decode_ok") if on_error == "drop" else out


def decoded(
    df: DataFrame, content: Column, rate: int = SAMPLE_RATE, on_error: str = "silence"
) -> DataFrame:
    """Add the decoder's columns; ``on_error="drop"`` leaves faulty rows out."""
    udf = decoder(rate, "null" if on_error == "drop" else on_error)
    out = df.withColumn("_decoded", udf(content)).select("*", "_decoded.*")
    out = out.drop("_decoded")
    return out.filter("decode_ok") if on_error == "drop" else out


def attach_audio(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``content``: each row reads its own file, so no bytes are shuffled.

    An unreadable file is null. Rows leave the task as soon as they hold a chunk
    of bytes, whatever their number.
    """
    schema = T.StructType([*df.schema, T.StructField("content", T.BinaryType())])

    def read(name: str) -> bytes | None:
        try:
            return read_bytes(name)
        except Exception:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, contents = 0, 0, []
            for at, name in enumerate(batch.column(path).to_pylist(), 1):
                contents.append(read(name))
                held += len(contents[-1] or b"")
                if held >= CHUNK_BYTES or at == batch.num_rows:
                    part = batch.slice(start, at - start)
                    columns = [*part.columns, pa.array(contents, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "content"])
                    start, held, contents = at, 0, []

    return df.mapInArrow(run, schema)


def resampler(target: int = SAMPLE_RATE):
    """Column UDF: samples and the row's own rate -> samples at ``target``."""

    @F.pandas_udf("array<float>")
    def resample(samples: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if s is None else wav.resample(np.asarray(s, np.float32), int(r), target)
                for s, r in zip(samples, rate)
            ],
            dtype=object,
        )

    return resample
