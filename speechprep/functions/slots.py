"""The slot-checked walk over generated tokens, as an Arrow UDF.

The walk has state (the slot expected next), which no built-in array function
carries cheaply: an ``aggregate`` fold copies its output array at every step.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import AUDIO_OFFSET, CODEBOOK, FRAME


def accepted(rows: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Mask of the audio tokens that a row-wise walk over the slots accepts.

    Tokens whose slots follow one another form a run. Inside a run the walk
    skips until the expected slot comes up and then takes all the rest, so one
    step per run is enough.
    """
    keep = np.zeros(len(slots), dtype=bool)
    if not len(slots):
        return keep
    new_row = np.diff(rows, prepend=rows[0] - 1) != 0
    breaks = new_row | (np.diff(slots, prepend=0) % FRAME != 1)
    starts = np.flatnonzero(breaks)
    ends = np.append(starts[1:], len(slots))
    expected = 0
    for start, end, slot, fresh in zip(
        starts.tolist(), ends.tolist(), slots[starts].tolist(), new_row[starts].tolist()
    ):
        if fresh:
            expected = 0
        first = start + (expected - slot) % FRAME
        if first < end:
            keep[first:end] = True
            expected = (slot + end - start) % FRAME
    return keep


# Rows whose tokens are walked at once.
ROWS_AT_ONCE = 512


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def in_slot_codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Relative codes of the tokens that sit in the slot expected at that point."""
    for ids in batches:
        for start in range(0, len(ids), ROWS_AT_ONCE):
            yield _in_slot(ids.slice(start, ROWS_AT_ONCE))


def _in_slot(ids: pa.Array) -> pa.Array:
    lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    tokens = ids.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    codes = tokens - AUDIO_OFFSET
    audio = (codes >= 0) & (codes < FRAME * CODEBOOK)
    rows, codes = rows[audio], codes[audio]
    keep = accepted(rows, codes // CODEBOOK)
    counts = np.bincount(rows[keep], minlength=len(lengths))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(codes[keep].astype(np.int32)), mask=ids.is_null()
    )
