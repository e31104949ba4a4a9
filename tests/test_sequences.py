"""Sequences, padding, vocabulary, batches, settings, prompts."""

import csv

import pytest
from pyspark.sql import functions as F

from speechprep.constants import DEFAULT_PROMPTS
from speechprep.functions import text as text_fn
from speechprep.operators import batching, vocab
from speechprep.operators.funnel import funnel
from speechprep.operators.rows import keep_columns
from speechprep.operators.sequences import (
    prompt_sequence,
    speaker_text,
    train_sequence,
    voice_text,
)
from speechprep.sinks.tables import write_batches
from speechprep.sources.prompts import nonblank, prompt_lines, split_block


def test_training_sequence(spark):
    df = spark.createDataFrame([([128000, 5], [128300] * 7)], "text_ids array<int>, codes array<int>")
    row = train_sequence(df).first()
    assert row.input_ids == (
        [128259, 128000, 5, 128009, 128260, 128261, 128257] + [128300] * 7 + [128258, 128262]
    )
    assert row.labels == row.input_ids and row.attention_mask == [1] * len(row.input_ids)
    assert keep_columns(train_sequence(df)).columns == ["input_ids", "labels", "attention_mask"]


def test_prompt_sequence(spark):
    df = spark.createDataFrame([([7],)], "text_ids array<int>")
    assert prompt_sequence(df).first().input_ids == [128259, 7, 128009, 128260, 128261, 128257]


def test_left_pad(spark):
    rows = [(1, [1, 2, 3]), (1, [4]), (2, [5])]
    df = spark.createDataFrame(rows, "batch int, input_ids array<int>")
    got = {tuple(r.input_ids): r.attention_mask for r in batching.left_pad(df, "batch").collect()}
    assert got == {(1, 2, 3): [1, 1, 1], (128263, 128263, 4): [0, 0, 1], (5,): [1]}


@pytest.mark.parametrize("side", ["left", "right"])
def test_collate(spark, side):
    rows = [(1, [1, 2, 3]), (1, [4])]
    df = spark.createDataFrame(rows, "batch int, input_ids array<int>").selectExpr(
        "*", "input_ids as labels", "transform(input_ids, x -> 1) as attention_mask"
    )
    got = {sum(r.attention_mask): r for r in batching.collate(df, "batch", side).collect()}
    assert got[3].labels == [1, 2, 3]
    short = got[1]
    if side == "left":
        assert (short.input_ids, short.labels) == ([128263, 128263, 4], [-100, -100, 4])
        assert short.attention_mask == [0, 0, 1]
    else:
        assert (short.input_ids, short.labels) == ([4, 128263, 128263], [4, -100, -100])
        assert short.attention_mask == [1, 0, 0]


def test_prefixes(spark):
    df = spark.createDataFrame([("ann", "hi"), (None, "hi"), ("", "hi")], "voice string, text string")
    assert [r.prompt for r in voice_text(df).collect()] == ["ann: hi", "hi", "hi"]
    assert [r.prompt for r in speaker_text(df).collect()] == ["hi"] * 3
    named = df.withColumnRenamed("voice", "source")
    assert [r.prompt for r in speaker_text(named).collect()] == ["ann: hi", "None: hi", ": hi"]
    show = df.select(
        text_fn.reference_prefix(F.col("text")), text_fn.preview(F.lit("x" * 60))
    ).first()
    assert tuple(show) == ("[Voice Reference] hi", "x" * 50 + "...")


def test_names(spark):
    df = spark.createDataFrame([(0,), (1233,)], "i int")
    names = df.select(
        text_fn.output_name(F.col("i")), text_fn.batch_name(F.col("i"), F.lit("một hai ba bốn năm sáu"))
    ).collect()
    assert names[0][0] == "generated_audio_001.wav" and names[1][0] == "generated_audio_1234.wav"
    assert names[0][1] == "batch_001_một_hai_ba_bốn_năm_s.wav"


VOCAB = [("a", 1), ("b", 2), ("c", 3)]
TWICE = [*VOCAB, ("b", 7), ("a", 0)]


@pytest.mark.parametrize("bound", [100, 2])
def test_tokenise_with_small_and_large_vocabulary(spark, bound):
    rows = [(1, "a b  zz\na"), (2, ""), (3, "c"), (4, None)]
    df = spark.createDataFrame(rows, "row int, text string")
    known = spark.createDataFrame(VOCAB, "token string, id int")
    coded = vocab.tokenise(df, known, unk=9, max_broadcast=bound)
    got = {r.row: r.text_ids for r in coded.collect()}
    assert got == {1: [128000, 1, 2, 9, 1], 2: [128000], 3: [128000, 3], 4: None}


@pytest.mark.parametrize("bound", [100, 1])
def test_repeated_entries_and_repeated_rows(spark, bound):
    known = spark.createDataFrame(TWICE, "token string, id int")
    df = spark.createDataFrame([("a b c",), ("a b c",), ("b",)], "text string")
    coded = vocab.tokenise(df, known, special=False, max_broadcast=bound)
    assert sorted(r.text_ids for r in coded.collect()) == [[0, 2, 3], [0, 2, 3], [2]]


def test_no_occurrence_is_shuffled_for_a_large_vocabulary(spark, monkeypatch):
    """Rows of any columns keep them; what moves is slices and distinct tokens of slices, not tokens."""
    monkeypatch.setattr(vocab, "SLICE_ROWS", 7)
    rows = [(n, " ".join(["hot"] * 50 + [f"w{n % 9}"]) if n % 5 else None, [n, None], {"k": n}) for n in range(100)]
    df = spark.createDataFrame(rows, "n int, text string, codes array<int>, m map<string,int>").repartition(3)
    known = spark.createDataFrame([("hot", 4), ("w1", 5), ("w2", 6)], "token string, id int")
    told = lambda bound: {r.n: (r.text, r.codes, r.m, r.text_ids) for r in vocab.tokenise(df, known, max_broadcast=bound).collect()}
    assert told(0) == told(10) and len(told(0)) == 100
    counted = []
    monkeypatch.setattr(vocab, "settled", lambda frame, name: counted.append((name, frame.count())) or frame.cache())
    vocab.tokenise(df, known, max_broadcast=0).collect()
    assert dict(counted)["slices"] < 25 and sum(n for _, n in counted) < 60  # of 4,080 occurrences


def test_audit_of_the_whole_table(spark):
    df = spark.range(300).selectExpr("id as n", "'a' as text")
    assert vocab.audit_sample(df, "n", n=None).count() == 300


def test_coverage(spark):
    known = spark.createDataFrame(VOCAB, "token string, id int")
    df = spark.createDataFrame([(0, "a b x"), (1, "x c")], "n int, text string")
    row = vocab.vocab_coverage(df, known).first()
    assert (row.total_texts_analyzed, row.total_tokens, row.unk_tokens) == (2, 5, 2)
    assert (row.coverage_rate, row.avg_tokens_per_text, row.coverage_flag) == (60.0, 2.5, "low")
    none = vocab.vocab_coverage(df.filter("n > 5"), known).first()
    assert (none.total_texts_analyzed, none.coverage_rate, none.avg_tokens_per_text) == (0, 0, 0)
    blank = vocab.vocab_coverage(spark.createDataFrame([("",)], "text string"), known).first()
    assert (blank.total_texts_analyzed, blank.total_tokens) == (1, 0)


def test_top_tokens_break_ties_by_first_place(spark):
    df = spark.createDataFrame([(2, "z y y"), (1, "q z w")], "n int, text string")
    top = vocab.top_tokens(vocab.tokens_of(df, "text", "n"), "n", k=3)
    assert [(r.token, r.n) for r in top.collect()] == [("z", 2), ("y", 2), ("q", 1)]


def test_audit_looks_at_the_first_texts(spark):
    df = spark.range(300).selectExpr("id as n", "'a' as text")
    assert {r.n for r in vocab.audit_sample(df, "n").collect()} == set(range(100))


def test_batch_plan(spark):
    plan = batching.batch_plan(spark.range(5), 2, 10).orderBy("batch_id").collect()
    assert [(r.start, r.end, r.size) for r in plan] == [(0, 2, 2), (2, 4, 2), (4, 5, 1)]
    assert {(r.total_batches, r.steps_per_batch, r.save_steps) for r in plan} == {(3, 3, 0)}
    assert batching.batch_plan(spark.range(0), 2, 10).count() == 0


def test_batch_plan_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(batching, "SEQUENCE_CHUNK", 3)
    plan = batching.batch_plan(spark.range(20), 2, 10).collect()
    assert sorted(r.batch_id for r in plan) == list(range(10))


def test_written_slices(spark, tmp_path):
    """One file a slice, whose rows are in order as they lie."""
    df = spark.createDataFrame([(n, f'say "{n}", twice') for n in range(110)], "n int, text string")
    path = tmp_path / "slices"
    write_batches(df.repartition(7), str(path), 40, "n")
    for k, want in enumerate([range(0, 40), range(40, 80), range(80, 110)]):
        files = list((path / f"batch_id={k}").glob("part-*"))
        assert len(files) == 1
        with files[0].open(newline="") as f:
            assert list(csv.reader(f)) == [["n", "text"], *[[str(n), f'say "{n}", twice'] for n in want]]


def test_settings_explicit_then_preset_then_base(spark):
    rows = [("stable", None, 0.1), ("expressive", 7, None), (None, None, None), ("odd", None, None)]
    df = spark.createDataFrame(rows, "preset string, max_new_tokens int, temperature double")
    got = {r.preset: r for r in batching.resolve_params(df).collect()}
    assert tuple(got["stable"])[1:] == (900, 0.1, 0.85, 1.08)
    assert tuple(got["expressive"])[1:] == (7, 0.7, 0.95, 1.02)
    assert tuple(got[None])[1:] == tuple(got["odd"])[1:] == (1200, 0.6, 0.95, 1.1)


def test_prompt_sources(spark, tmp_path):
    path = tmp_path / "p.txt"
    path.write_text("  one \n\n\t\ntwo\n", encoding="utf-8")
    texts = lambda df: [r.text for r in df.collect()]
    assert texts(prompt_lines(spark, path=str(path))) == ["one", "two"]
    assert texts(prompt_lines(spark, "own", str(path))) == ["own"]
    assert texts(prompt_lines(spark)) == DEFAULT_PROMPTS
    block = spark.createDataFrame([(1, " a \n\n b"), (2, " \n")], "k int, text string")
    rows = split_block(block, F.col("text"), ["k"]).collect()
    assert [(r.k, r.idx, r.text) for r in rows] == [(1, 0, "a"), (1, 1, "b")]
    assert nonblank(block).count() == 1


def test_funnel_counts_rows_that_pass_all_stages_so_far(spark):
    df = spark.createDataFrame([(1, True), (2, None), (3, False), (4, True)], "n int, ok boolean")
    row = funnel(df, all=F.lit(True), ok=F.col("ok"), large=F.col("n") > 3).first()
    assert tuple(row) == (4, 2, 1)


def test_a_hot_batch_is_split_by_the_skew_join(spark):
    """A third of all rows in one batch: its partition of the join is divided."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(60_000).repartition(8).selectExpr(
            "if(id % 3 = 0, -1, id div 4) as batch",
            "transform(sequence(0, id % 40), x -> cast(id * 7 + x as int)) as input_ids",
        )
        padded = batching.left_pad(rows, "batch")
        got = padded.groupBy("batch").agg(
            F.count("*").alias("n"), F.count_distinct(F.size("input_ids")).alias("sizes")
        )
        assert got.filter("sizes > 1").count() == 0
        assert got.filter("batch = -1").first().n == 20_000
        final = padded.collect() and padded._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in final
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
