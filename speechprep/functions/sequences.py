"""Token sequences with control tokens around text and speech."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def _ids(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values])


def training_ids(text_ids: Column, codes: Column) -> Column:
    return F.concat(
        _ids(C.START_OF_HUMAN),
        text_ids,
        _ids(C.END_OF_TEXT, C.END_OF_HUMAN, C.START_OF_AI, C.START_OF_SPEECH),
        codes,
        _ids(C.END_OF_SPEECH, C.END_OF_AI),
    )


def prompt_ids(text_ids: Column) -> Column:
    return F.concat(
        _ids(C.START_OF_HUMAN),
        text_ids,
        _ids(C.END_OF_TEXT, C.END_OF_HUMAN, C.START_OF_AI, C.START_OF_SPEECH),
    )


def ones(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def padded(values: Column, fill: int, width: Column, side: str) -> Column:
    gap = F.array_repeat(F.lit(fill), width - F.size(values))
    return F.concat(gap, values) if side == "left" else F.concat(values, gap)
