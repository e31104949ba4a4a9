"""Frames and token streams: hand cases, brute force, properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from speechprep.constants import AUDIO_OFFSET, CODEBOOK, FRAME
from speechprep.functions.slots import accepted
from speechprep.operators.extraction import classify_token, crop_batchwise, extract_codes
from speechprep.operators.frames import (
    collapse_frames,
    deinterleave,
    explode_frames,
    frame_runs,
    interleave,
)
from speechprep.operators.rows import has_codes

MARK, STOP = 128257, 128258
LAYERS = "row int, l1 array<int>, l2 array<int>, l3 array<int>"


def frames_of(*firsts):
    return [code for n, first in enumerate(firsts) for code in (first, n, n, n, n, n, n)]


def by_row(df, *columns):
    return {r["row"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_interleave_by_hand(spark):
    rows = [
        (1, [1, 2], [10, 11, 12, 13], list(range(20, 28))),
        (2, [1, 2], [10, 11, 12], list(range(20, 28))),
        (3, [], [], []),
        (4, None, [1], [1]),
    ]
    got = by_row(interleave(spark.createDataFrame(rows, LAYERS)), "codes")
    assert got[1] == (
        [128267, 132372, 136478, 140575, 144661, 148768, 152865]
        + [128268, 132374, 136482, 140579, 144663, 148772, 152869],
    )
    assert got[2] == (None,) and got[3] == ([],) and got[4] == (None,)


def test_deinterleave_undoes_interleave(spark):
    draw = np.random.default_rng(1)
    rows = []
    for row, t in enumerate([0, 1, 2, 7, 40]):
        l1, l2, l3 = (draw.integers(0, CODEBOOK, n * t).tolist() for n in (1, 2, 4))
        rows.append((row, l1, l2, l3))
    df = interleave(spark.createDataFrame(rows, LAYERS)).drop("l1", "l2", "l3")
    relative = df.withColumn("codes", F.transform("codes", lambda c: c - AUDIO_OFFSET))
    got = by_row(deinterleave(relative), "l1", "l2", "l3")
    assert got == {row: tuple(layers) for row, *layers in rows}


def test_deinterleave_drops_a_tail(spark):
    df = spark.createDataFrame([(1, list(range(9)))], "row int, codes array<int>")
    assert len(deinterleave(df).first()["l1"]) == 1


def test_collapse_by_hand(spark):
    rows = [
        (1, frames_of(5, 5, 5, 7, 5)),
        (2, []),
        (3, [1, 2, 3]),
        (4, None),
        (5, frames_of(9)),
    ]
    df = spark.createDataFrame(rows, "row int, codes array<int>")
    got = by_row(collapse_frames(df), "codes", "removed")
    assert got[1][0][::7] == [5, 7, 5] and got[1][1] == 2
    assert got[1][0][1::7] == [0, 3, 4]
    assert got[2] == ([], 0) and got[3] == (None, None) and got[4] == (None, None)
    assert got[5] == (frames_of(9), 0)
    assert {r["row"] for r in has_codes(collapse_frames(df)).collect()} == {1, 5}


def test_collapse_is_idempotent_and_leaves_no_neighbours_alike(spark):
    draw = np.random.default_rng(2)
    rows = [(n, frames_of(*draw.integers(0, 3, n).tolist())) for n in range(60)]
    df = spark.createDataFrame(rows, "row int, codes array<int>")
    once = collapse_frames(df)
    kept = by_row(once, "codes", "removed")
    for row, codes in rows:
        assert len(codes) == len(kept[row][0]) + FRAME * kept[row][1]
        firsts = kept[row][0][::FRAME]
        assert all(a != b for a, b in zip(firsts, firsts[1:]))
    twice = by_row(collapse_frames(once), "codes", "removed")
    assert twice == {row: (codes, 0) for row, (codes, _) in kept.items()}


@pytest.mark.parametrize("stretch", [1, 2, 7, 1000])
def test_long_form_equals_array_form(spark, stretch):
    draw = np.random.default_rng(3)
    rows = [(n, frames_of(*draw.integers(0, 2, n).tolist())) for n in range(1, 25)]
    df = spark.createDataFrame(rows, "row int, codes array<int>")
    runs = frame_runs(explode_frames(df, "row"), "row", stretch=stretch)
    long = {}
    for r in runs.orderBy("row", "frame").collect():
        long.setdefault(r["row"], []).extend(r[f"c{k}"] for k in range(FRAME))
    assert long == {k: v[0] for k, v in by_row(collapse_frames(df), "codes").items()}


def walk(ids):
    """One token at a time, as the definition says."""
    if MARK in ids:
        ids = ids[len(ids) - ids[::-1].index(MARK) :]
    found = []
    for token in ids:
        if token in (128258, 128262, 128263):
            break
        if (token - AUDIO_OFFSET) // CODEBOOK == len(found) % FRAME:
            found.append(token - AUDIO_OFFSET)
    return found[: len(found) // FRAME * FRAME]


FRAME_IDS = [128267, 132365, 136458, 140554, 144650, 148746, 152842]


def test_extraction_by_hand(spark):
    noisy = [MARK, 1, MARK, 128267, 128267, 132365, 99, 136458, 140554, 144650, 148746]
    rows = [
        (1, [5, *noisy, 152842, 128273, STOP, 128266]),
        (2, [1, 2, 3]),
        (3, [MARK]),
        (4, [STOP, *FRAME_IDS]),
        (5, FRAME_IDS * 2 + FRAME_IDS[:6]),
        (6, None),
        (7, []),
    ]
    df = spark.createDataFrame(rows, "row int, ids array<int>")
    got = by_row(extract_codes(df), "codes")
    assert got[1] == ([1, 4099, 8192, 12288, 16384, 20480, 24576],)
    assert got[2] == got[3] == got[4] == got[7] == ([],)
    assert got[5] == ([i - AUDIO_OFFSET for i in FRAME_IDS * 2],)
    assert got[6] == (None,)


def test_extraction_equals_the_token_walk(spark):
    draw = np.random.default_rng(4)
    rows = []
    for row in range(300):
        n = int(draw.integers(0, 120))
        slots = (np.arange(n) + draw.integers(0, 7)) % FRAME
        slots = np.where(draw.random(n) < 0.1, draw.integers(0, 7, n), slots)
        ids = AUDIO_OFFSET + slots * CODEBOOK + draw.integers(0, CODEBOOK, n)
        special = draw.choice([MARK, STOP, 128262, 128263, 17, 160000], n)
        ids = np.where(draw.random(n) < 0.03, special, ids)
        rows.append((row, ids.tolist()))
    df = spark.createDataFrame(rows, "row int, ids array<int>").repartition(3)
    got = by_row(extract_codes(df), "codes")
    assert got == {row: (walk(ids),) for row, ids in rows}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 6)), max_size=60))
def test_run_steps_equal_token_steps(tokens):
    tokens.sort(key=lambda t: t[0])
    rows = np.array([t[0] for t in tokens], int)
    slots = np.array([t[1] for t in tokens], int)
    want, expected, last = [], 0, None
    for row, slot in tokens:
        expected = expected if row == last else 0
        want.append(slot == expected)
        expected, last = (expected + 1) % FRAME if slot == expected else expected, row
    assert accepted(rows, slots).tolist() == want


def test_crop_of_a_batch_takes_the_last_row_with_a_marker(spark):
    rows = [
        ("a", 0, [1, 2, MARK, 4, 5]),
        ("a", 1, [MARK, 7, 8, 9, 10]),
        ("a", 2, [11, 12, 13, 14, 15]),
        ("b", 0, [1, 2]),
    ]
    df = spark.createDataFrame(rows, "batch string, row int, ids array<int>")
    got = {(r.batch, r.row): r.ids for r in crop_batchwise(df, "batch", "row").collect()}
    assert got["a", 0] == [2, MARK, 4, 5] and got["a", 1] == [7, 8, 9, 10]
    assert got["a", 2] == [12, 13, 14, 15] and got["b", 0] == [1, 2]


def test_classes_of_tokens(spark):
    ids = [0, 128000, 128256, 128257, 128266, 128266 + 4 * CODEBOOK + 5, 156937, 156938, -1]
    df = spark.createDataFrame([(i,) for i in ids], "token int")
    got = {r.token: (r.kind, r.name, r.slot, r.layer, r.code) for r in classify_token(df).collect()}
    assert got[0][0] == "text" and got[128000][:2] == ("control", "start_of_text")
    assert got[128257][:2] == ("control", "start_of_speech")
    assert got[128256][0] == got[156938][0] == got[-1][0] == "unused"
    assert got[128266] == ("audio", None, 0, 1, 0)
    assert got[128266 + 4 * CODEBOOK + 5] == ("audio", None, 4, 2, 5)
    assert got[156937] == ("audio", None, 6, 3, 4095)
