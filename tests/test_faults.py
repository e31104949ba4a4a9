"""Cases that once lost rows, spoiled them, or ran a model twice."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechprep.functions import wav
from speechprep.operators.frames import frame_runs
from speechprep.operators.models import apply_generator, apply_tokenizer
from speechprep.plans.training import prepare_table
from speechprep.sources.audio_files import decoded

FRAMES = "row int, frame long, c0 int"


@pytest.mark.parametrize("stretch", [1, 2, 4, 100])
@pytest.mark.parametrize(
    ("frames", "kept"),
    [
        ([(0, 1), (1, 2), (2, 3), (4, 4), (5, 5), (9, 6)], [0, 1, 2, 4, 5, 9]),
        ([(1, 7), (2, 7), (3, 8)], [1, 3]),
        ([(3, 5), (40, 5), (41, 6), (90, 6), (91, 5)], [3, 41, 91]),
        ([(0, None), (1, None), (2, 4), (8, None)], [0, 2, 8]),
    ],
)
def test_frame_runs_with_gaps_and_nulls(spark, frames, kept, stretch):
    df = spark.createDataFrame([(1, at, code) for at, code in frames], FRAMES)
    got = frame_runs(df, "row", stretch=stretch)
    assert got.columns == df.columns
    assert [r.frame for r in got.orderBy("frame").collect()] == kept


def calls(acc):
    def factory():
        def model(*inputs):
            acc.add(1)
            if inputs[0] is None:
                raise ValueError("no input")
            return [1, 2]

        return model

    return factory


def test_a_filter_does_not_run_the_model_twice(spark):
    count = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(k, [k]) for k in range(8)], "k int, p array<int>")
    made = apply_generator(df, calls(count), ["p"]).filter("ids is not null")
    assert len(made.collect()) == 8 and count.value == 8


def test_dropping_faulty_audio_decodes_once(spark):
    df = spark.createDataFrame([(k, bytearray(b"junk")) for k in range(3)], "k int, content binary")
    out = decoded(df, F.col("content"), on_error="drop")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and out.count() == 0


def test_rows_without_text_ids_are_left_out(spark):
    rows = [(1, "a", list(range(128266, 128273))), (2, None, list(range(128266, 128273)))]
    df = spark.createDataFrame(rows, "k int, text string, codes array<int>")
    count = spark.sparkContext.accumulator(0)
    out = prepare_table(df, lambda d: d, lambda d: apply_tokenizer(d, calls(count))).collect()
    assert len(out) == 1 and all(r.input_ids is not None for r in out)


def test_odd_rates_stay_small_and_absurd_ones_fail():
    tracemalloc.start()
    out = wav.resample(np.ones(44_101, np.float32), 44_101, 24_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 24_000 and peak < 50e6 and abs(out[1000:-1000] - 1).max() < 1e-2
    for rate in (0, -1, 2_000_000_000):
        with pytest.raises(ValueError):
            wav.resample(np.ones(10, np.float32), rate, 24_000)
