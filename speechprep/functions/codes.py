"""Codec-code arrays: interleave, split back, collapse, crop.

All are built-in array expressions. Pass plain columns, not long expressions:
the lambdas read their argument once per element.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    AUDIO_OFFSET,
    CODEBOOK,
    FRAME,
    FRAME_LAYOUT,
    LAYER_WIDTH,
    START_OF_SPEECH,
    STOP_IDS,
)


def _div(a: Column, n: int) -> Column:
    return F.call_function("div", a, F.lit(n)).cast("int")


def _positions(n: Column) -> Column:
    """``[0, n)``; ``sequence(0, -1)`` would count down, so zero is guarded."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
        F.array().cast("array<int>")
    )


def frame_count(codes: Column) -> Column:
    return _div(F.size(codes), FRAME)


def interleave(l1: Column, l2: Column, l3: Column) -> Column:
    """Three layers of sizes T, 2T, 4T -> flat token ids, seven per frame.

    Null when a layer is null or too short.
    """
    layers = {1: l1, 2: l2, 3: l3}

    def frame(i: Column) -> Column:
        return F.array(
            *[
                F.get(layers[layer], LAYER_WIDTH[layer] * i + phase)
                + F.lit(AUDIO_OFFSET + k * CODEBOOK)
                for k, (layer, phase) in enumerate(FRAME_LAYOUT)
            ]
        )

    long_enough = (F.size(l2) >= 2 * F.size(l1)) & (F.size(l3) >= 4 * F.size(l1))
    return F.when(
        long_enough, F.flatten(F.transform(_positions(F.size(l1)), frame))
    ).cast("array<int>")


def interleaved(l1, l2, l3):
    """The same of one row's layers inside a Python worker; sequences or numpy arrays, which may hold None."""
    if l1 is None or l2 is None or l3 is None or len(l2) < 2 * len(l1) or len(l3) < 4 * len(l1):
        return None
    layers = {1: l1, 2: l2, 3: l3}
    if any(not isinstance(x, np.ndarray) and None in x for x in layers.values()):
        return [
            None if (code := layers[layer][LAYER_WIDTH[layer] * i + phase]) is None else code + AUDIO_OFFSET + k * CODEBOOK
            for i in range(len(l1))
            for k, (layer, phase) in enumerate(FRAME_LAYOUT)
        ]
    flat = np.empty((len(l1), FRAME), np.int64)
    for k, (layer, phase) in enumerate(FRAME_LAYOUT):
        width = LAYER_WIDTH[layer]
        own = np.asarray(layers[layer][: width * len(l1)]).reshape(-1, width)[:, phase]
        if len(own) and own.dtype.kind not in "iu":
            raise TypeError(f"codes of layer {layer} are not whole numbers")
        flat[:, k] = own
        flat[:, k] += AUDIO_OFFSET + k * CODEBOOK
    return flat.ravel()


def layer_of(codes: Column, layer: int) -> Column:
    """One layer back out of flat relative codes; a tail below a frame is dropped."""
    slots = [
        (phase, k) for k, (owner, phase) in enumerate(FRAME_LAYOUT) if owner == layer
    ]

    def pick(i: Column) -> Column:
        return F.array(
            *[F.get(codes, FRAME * i + k) - F.lit(k * CODEBOOK) for _, k in sorted(slots)]
        )

    return F.flatten(F.transform(_positions(frame_count(codes)), pick)).cast("array<int>")


def collapse(codes: Column) -> Column:
    """Keep a frame iff its first code differs from the frame before it.

    Comparing with the immediate predecessor equals comparing with the last kept
    frame, because a dropped frame has the same first code as the kept one.
    Null when the length is no multiple of seven.
    """
    kept = F.filter(
        _positions(frame_count(codes)),
        lambda i: (i == 0) | (F.get(codes, FRAME * i) != F.get(codes, FRAME * i - FRAME)),
    )
    frames = F.transform(kept, lambda i: F.slice(codes, FRAME * i + 1, FRAME))
    return F.when(F.size(codes) % FRAME == 0, F.flatten(frames))


def whole_frames(codes: Column) -> Column:
    return F.slice(codes, F.lit(1), frame_count(codes) * FRAME)


def last_marker(ids: Column) -> Column:
    """1-based position of the last start-of-speech id, null when there is none."""
    back = F.array_position(F.reverse(ids), START_OF_SPEECH).cast("int")
    return F.when(back > 0, F.size(ids) - back + 1)


def after(ids: Column, position: Column) -> Column:
    """What follows a 1-based position; all of it when the position is null."""
    rest = F.greatest(F.size(ids) - position, F.lit(0))
    return F.when(position.isNull(), ids).otherwise(F.slice(ids, position + 1, rest))


def before_stop(ids: Column) -> Column:
    """What precedes the first stop id."""
    first = F.least(
        *[F.nullif(F.array_position(ids, stop), F.lit(0)) for stop in STOP_IDS]
    ).cast("int")
    return F.when(first.isNull(), ids).otherwise(F.slice(ids, F.lit(1), first - 1))
