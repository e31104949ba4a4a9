"""Audio files, waveforms and models, and the flows over them."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog.standins import dequantiser, echo, quantiser, without_top_p
from speechprep.functions import wav
from speechprep.functions.audio import first_channel
from speechprep.operators import models, vocab
from speechprep.operators.audio import or_silence, peak_normalise
from speechprep.plans import generation, training
from speechprep.sinks.tables import export_manifest
from speechprep.sinks.wavs import write_wavs
from speechprep.sources import audio_files, tables
from speechprep.sources.manifest import read_manifest
from speechprep.streaming.ingest import incremental_ingest

SINE = np.sin(2 * np.pi * 440 * np.arange(8000) / 16000).astype(np.float32)


def pcm(values, bits, channels=1, rate=8000, kind=wav.PCM):
    body = b"".join(int(v).to_bytes(bits // 8, "little", signed=bits > 8) for v in values)
    block = channels * bits // 8
    form = struct.pack("<HHIIHH", kind, channels, rate, rate * block, block, bits)
    inner = b"WAVEfmt " + struct.pack("<I", 16) + form
    inner += b"LIST" + struct.pack("<I", 3) + b"abc\0"  # an odd chunk in between
    inner += b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(inner)) + inner


@pytest.mark.parametrize("bits, values", [(8, [0, 128, 192]), (16, [-32768, 0, 16384]),
                                          (24, [-(2**23), 0, 2**22]), (32, [-(2**31), 0, 2**30])])
def test_pcm_depths(bits, values):
    samples, rate = wav.read_wav(pcm(values, bits))
    assert rate == 8000 and samples.tolist() == [[-1, 0, 0.5]]


def test_round_trip_and_mono():
    for encoding, error in [("float32", 0), ("pcm16", 1e-4)]:
        samples, rate = wav.read_wav(wav.write_wav(np.stack([SINE, -SINE]), 16000, encoding))
        assert rate == 16000 and np.abs(samples[0] - SINE).max() <= error
        assert np.abs(wav.mono(samples)).max() <= error


def test_extensible_and_double_files():
    plain = pcm([0, 16384], 16)
    form = struct.pack("<HHIIHHHHIH14x", wav.EXTENSIBLE, 1, 8000, 16000, 2, 16, 22, 16, 0, wav.PCM)
    tail = plain[plain.index(b"data") :]
    inner = b"WAVEfmt " + struct.pack("<I", len(form)) + form + tail
    wide = b"RIFF" + struct.pack("<I", len(inner)) + inner
    assert wav.read_wav(wide)[0].tolist() == [[0, 0.5]]
    body = np.array([0.25, -0.5], "<f8").tobytes()
    form = struct.pack("<HHIIHH", wav.IEEE_FLOAT, 1, 8000, 64000, 8, 64)
    inner = b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", 16) + body
    double = b"RIFF" + struct.pack("<I", len(inner)) + inner
    assert wav.read_wav(double)[0].tolist() == [[0.25, -0.5]]


@pytest.mark.parametrize("bad", [b"", b"RIFF", b"x" * 100, pcm([1], 16)[:30], pcm([1], 16, kind=7)])
def test_undecodable(bad):
    with pytest.raises(Exception):
        wav.read_wav(bad)


@pytest.mark.parametrize("old, new", [(16000, 24000), (44100, 24000), (48000, 24000), (8000, 24000)])
def test_resample_length_level_and_tone(old, new):
    for n in (1, 2, 7, 100, old):
        assert len(wav.resample(np.ones(n, np.float32), old, new)) == math.ceil(n * new / old)
    level = wav.resample(np.ones(old, np.float32), old, new)
    assert np.abs(level[200:-200] - 1).max() < 1e-3
    tone = lambda rate: np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
    heard = wav.resample(tone(old).astype(np.float32), old, new)
    assert np.abs(heard - tone(new))[200:-200].max() < 2e-3
    assert wav.resample(SINE, new, new) is SINE


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("audio")
    (path / "good.wav").write_bytes(wav.write_wav(SINE, 16000))
    (path / "stereo.wav").write_bytes(wav.write_wav(np.stack([SINE, -SINE]), 24000))
    (path / "empty.wav").write_bytes(wav.write_wav(np.zeros(0), 24000))
    (path / "broken.wav").write_bytes(b"no audio")
    return str(path)


def test_decode_a_folder(spark, folder):
    def decoded(on_error):
        rows = audio_files.decode_audio(spark, folder, on_error=on_error).collect()
        return {r.path.rsplit("/", 1)[1]: r for r in rows}

    got = decoded("silence")
    assert len(got["good.wav"].samples) == 12000 and got["good.wav"].source_rate == 16000
    assert max(map(abs, got["stereo.wav"].samples)) == 0 and got["stereo.wav"].decode_ok
    for bad in ("empty.wav", "broken.wav"):
        assert got[bad].samples == [0] * 24000 and not got[bad].decode_ok and got[bad].error
    assert decoded("null")["broken.wav"].samples is None
    assert set(decoded("drop")) == {"good.wav", "stereo.wav"}
    sizes = {r.path.rsplit("/", 1)[1]: r.length for r in audio_files.audio_inventory(spark, folder).collect()}
    assert sizes["broken.wav"] == 8 and len(sizes) == 4


def test_listing_sees_all_names_at_any_depth(spark, tmp_path):
    names = ["a.wav", "_b.wav", ".c.wav", "x/d.wav", "x/_y/e f%20.wav", "x/.z/g.wav", "x/q/r/s/t.wav"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"abc")
    (tmp_path / "empty").mkdir()
    (tmp_path / "x" / "loop").symlink_to(tmp_path)
    found = audio_files.audio_inventory(spark, f"file://{tmp_path}")
    assert sorted((r.path, r.length) for r in found.collect()) == sorted((f"{tmp_path}/{n}", 3) for n in names)
    assert all(r.modificationTime.year >= 2024 for r in found.collect())
    sizes = audio_files.sized(found.select("path")).collect()
    assert all(r.length == 3 for r in sizes)
    assert audio_files.audio_inventory(spark, f"{tmp_path}/empty", f"{tmp_path}/nothing").count() == 0
    assert audio_files.audio_inventory(spark, f"{tmp_path}/a.wav").count() == 1


def test_decoding_holds_a_chunk_at_a_time(spark, tmp_path, monkeypatch):
    """Rows leave the task by bytes: no batch holds much more than a chunk, however many files there are."""
    for k in range(40):
        (tmp_path / f"{k}.wav").write_bytes(wav.write_wav(np.ones(24000, np.float32), 24000))
    monkeypatch.setattr(audio_files, "CHUNK_BYTES", 200_000)
    rows = (audio_files._decoded(lambda: (tmp_path / f"{k}.wav").read_bytes(), 24000, "null") for k in range(40))
    sizes = [n for n, _ in audio_files._by_bytes(rows, 40)]
    assert sum(sizes) == 40 and max(sizes) <= 3
    got = audio_files.decode_audio(spark, str(tmp_path)).collect()
    assert len(got) == 40 and all(len(r.samples) == 24000 and r.decode_ok for r in got)


def test_missing_file_is_null_content_and_silence(spark, folder):
    df = spark.createDataFrame([(f"{folder}/good.wav",), (f"{folder}/none.wav",)], "path string")
    loaded = audio_files.attach_audio(df)
    rows = audio_files.decoded(loaded, F.col("content")).collect()
    assert [r.decode_ok for r in rows] == [True, False] and rows[1].content is None
    assert len(rows[1].samples) == 24000


@pytest.mark.parametrize("chunk", [1, 10**9])
def test_contents_leave_in_chunks(spark, folder, monkeypatch, chunk):
    monkeypatch.setattr(audio_files, "CHUNK_BYTES", chunk)
    names = ["good", "none", "broken", "stereo"] * 3
    df = spark.createDataFrame([(n, f"file:{folder}/{n}.wav") for n in names], "n string, path string")
    got = sorted((r.n, r.content and len(r.content)) for r in audio_files.attach_audio(df).collect())
    sizes = {"good": 32044, "none": None, "broken": 8, "stereo": 64044}
    assert got == sorted((n, sizes[n]) for n in names)


@pytest.mark.parametrize("values", [1, 3, 10**9])
def test_model_output_leaves_in_chunks(spark, monkeypatch, values):
    monkeypatch.setattr(models, "CHUNK_VALUES", values)
    repeat = lambda: lambda n: [n] * (n % 3)
    done = models.apply_model(spark.range(20).coalesce(2), repeat, ["id"], "out", "array<long>")
    assert all(r.out == [r.id] * (r.id % 3) for r in done.collect()) and done.count() == 20


def test_names_with_blanks_and_accents(spark, tmp_path):
    paths = [f"{tmp_path}/tiếng việt 1.wav", f"file://{tmp_path}/a b#%20.wav"]
    df = spark.createDataFrame([(p, [0.5]) for p in paths], "path string, samples array<float>")
    assert all(r.ok for r in write_wavs(df).collect())
    found = audio_files.audio_inventory(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {p.removeprefix("file://") for p in paths}
    rows = audio_files.attach_audio(found.select("path")).collect()
    assert all(len(r.content) == 48 for r in rows)


def test_write_reports_each_row(spark, tmp_path):
    rows = [(f"{tmp_path}/a/x.wav", [0.5, -0.5]), (f"{tmp_path}/a/y.wav", None), ("/proc/no/z.wav", [0.0])]
    done = write_wavs(spark.createDataFrame(rows, "path string, samples array<float>"))
    done.write.parquet(f"{tmp_path}/report")
    report = spark.read.parquet(f"{tmp_path}/report")
    got = {r.path: (r.ok, r.error) for r in report.collect()}
    assert got[rows[0][0]] == (True, None)
    assert got[rows[1][0]] == (False, "no samples") and not got[rows[2][0]][0]
    assert [r.file_name for r in export_manifest(report).collect()] == ["x.wav"]
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["x.wav"]


def test_channels_peak_and_silence(spark):
    rows = [(1, [[0.5, -2.0], [9.0]], [1]), (2, [[0.5, -1.0]], []), (3, [[]], [2])]
    df = spark.createDataFrame(rows, "n int, channels array<array<float>>, codes array<int>")
    mono = df.withColumn("samples", first_channel(F.col("channels")))
    got = {r.n: r.samples for r in peak_normalise(mono).collect()}
    assert got == {1: [0.25, -1.0], 2: [0.5, -1.0], 3: []}
    quiet = {r.n: r.samples for r in or_silence(mono).collect()}
    assert quiet[2] == [0.0] * 1000 and quiet[1] == [0.5, -2.0]


def test_model_is_made_once_per_task_and_failures_are_rows(spark):
    def factory():
        calls = []

        def model(n):
            calls.append(n)
            if n == 3:
                raise ValueError("three")
            return [len(calls)]

        return model

    df = spark.range(6).coalesce(1)
    rows = models.apply_model(df, factory, ["id"], "out", "array<int>").orderBy("id").collect()
    assert [r.out for r in rows] == [[1], [2], [3], None, [5], [6]]
    assert [r.error for r in rows] == [None, None, None, "three", None, None]


def test_generator_retries_on_simpler_settings(spark):
    rows = [(1, [5], 9, 0.95), (2, [5], 9, 0.5), (3, [5], 0, 0.5)]
    df = spark.createDataFrame(rows, "n int, input_ids array<int>, max int, top_p double")
    done = models.apply_generator(df, echo, ["input_ids", "max", "top_p"], without_top_p)
    got = {r.n: (r.ids, r.error) for r in done.collect()}
    assert got[1] == got[2] == ([128257, 128271, 128258], None)
    assert got[3] == (None, "max_new_tokens")


@pytest.mark.parametrize("budget, failing, most", [(1, 4, 30), (12, 4, 30), (10**6, 4, 32), (10**6, 1, 12), (10**6, 0, 1)])
def test_generator_in_batches(spark, tmp_path, budget, failing, most):
    """Results as row by row, fewer calls, and one retry for the row that fails alone."""
    low = [3, 17][:failing]
    rows = [(k, [k] * (k % 5 + 1), 100, 0.1 if k in low else 1.0) for k in range(24)]
    rows += [(24, None, 100, 1.0), (25, [1], 0, 1.0)] if failing == 4 else []
    df = spark.createDataFrame(rows, "k int, ids_in array<int>, max int, top_p double").coalesce(1)
    calls = tmp_path / "calls"

    def batch():
        model = echo()

        def run(rows):
            with calls.open("a") as f:
                f.write(f"{len(rows)} ")
            return [model(*row) for row in rows]

        return run

    single = models.apply_generator(df, echo, ["ids_in", "max", "top_p"], without_top_p).collect()
    done = models.apply_generator(df, batch, ["ids_in", "max", "top_p"], without_top_p, budget=budget).collect()
    told = lambda rows: {r.k: (r.ids, r.error) for r in rows}
    assert told(done) == told(single) and sum(r.error is not None for r in done) == (2 if failing == 4 else 0)
    sizes = [int(n) for n in calls.read_text().split()]
    assert len(sizes) <= most and (budget == 1) == (max(sizes) == 1)


def test_batches_hold_rows_of_like_length():
    seen = []

    def model(rows):
        seen.append([len(x) for (x,) in rows])
        return [x if len(x) != 7 else KeyError("seven") for (x,) in rows]

    rows = [([0] * n,) for n in (9, 1, 7, 2, 9, 1, 30, 2)]
    done = models.batched_calls(model, None, 18, models._cost)(rows)
    assert [e for _, e in done] == [None, None, "'seven'", None, None, None, None, None]
    assert [v for v, e in done if not e] == [x for (x,) in rows if len(x) != 7]
    assert seen == [[1, 1, 2, 2], [7, 9], [9], [30]] or all(len(s) * max(s) <= 18 or len(s) == 1 for s in seen)


def test_row_functions(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "n int, text string")
    mapped = models.map_rows(df, lambda r: {"words": r["text"].split()}, "words array<string>", ["text"])
    rows = mapped.orderBy("n").collect()
    assert mapped.columns == ["n", "words", "error"]
    assert rows[0].words == ["a", "b"] and rows[1].words is None and rows[1].error
    assert models.filter_rows(df, lambda n: n > 1, "n").count() == 1
    assert models.filter_rows(df, F.col("n") > 1).count() == 1


def test_hooks_leave_other_values_alone(spark):
    rows = [(2**53 + 1, 1, [1, 2]), (None, None, None), (2**53 + 3, 2, [3, 4])]
    df = spark.createDataFrame(rows, "big long, lim int, ids array<int>").coalesce(1)
    mapped = models.map_rows(df, lambda r: {"twice": r["lim"] * 2}, "twice int").collect()
    assert [(r.big, r.twice) for r in mapped] == [(2**53 + 1, 2), (None, None), (2**53 + 3, 4)]
    cut = lambda: lambda ids, lim: ids[:lim]
    done = models.apply_model(df, cut, ["ids", "lim"], "out", "array<int>").collect()
    assert [r.out for r in done] == [[1], None, [3, 4]] and done[1].error
    again = models.apply_model(df, cut, ["ids", "lim"], "out", "array<int>")
    again = models.apply_model(again, lambda: lambda n: [0], ["lim"], "more", "array<int>").collect()
    assert again[1].error and again[1].more == [0] and again[0].error is None
    assert models.filter_rows(df, lambda n: isinstance(n, int), "lim").count() == 2


def test_manifest_flow_reads_audio_late(spark, folder):
    rows = [("m", 0, "good.wav", "hello"), ("m", 1, "none.wav", "x"), ("m", 2, "broken.wav", "y"),
            ("m", 3, "stereo.wav", "z")]
    df = spark.createDataFrame(rows, "file string, pos long, audio string, text string")
    inventory = audio_files.audio_inventory(spark, folder)
    tokenise = lambda d: models.apply_tokenizer(d, lambda: lambda t: [len(t)]).drop("error")
    prepare = lambda where=folder, **o: training.prepare_manifest(
        df, inventory, training.encode_files(quantiser, **o), tokenise, where, max_samples=3
    )
    run = lambda *a, **o: prepare(*a, **o).rows
    built = {r.input_ids[1]: r for r in run().collect()}
    assert set(built) == {5, 1} and built[5].labels == built[5].input_ids
    assert len(built[1].input_ids) == 6 + 7 + 2 - 0  # silence is one frame after the collapse
    assert run(on_error="null").count() == 1 and run("file://" + folder).count() == 2
    asked = training.manifest_rows(df, None, folder)
    assert sorted(r.text for r in asked.collect()) == ["hello", "y", "z"]
    funnel = training.stage_funnel(df, inventory, training.encode_files(quantiser), folder).first()
    assert tuple(funnel) == (4, 3, 3, 3, 3)
    done = prepare()
    names = ["manifest_rows", "audio_found", "codes_not_null", "codes_not_empty", "frames_left", "text_ids_not_null"]
    assert done.funnel == dict(zip(names, (3, 2, 2, 2, 2, 2))) | {"undecodable": 1, "failed_rows": 0}
    told = {(r.text, r.step, r.trained): r.error for r in done.faults.collect()}
    assert set(told) == {("x", "find", False), ("y", "decode", True)} and told["y", "decode", True]
    lost = prepare(on_error="null")
    assert lost.funnel["codes_not_null"] == 1 and lost.funnel["failed_rows"] == 1
    assert {(r.step, r.trained) for r in lost.faults.collect()} == {("find", False), ("decode", False)}


def test_each_found_row_is_encoded_once(spark, folder, tmp_path):
    """While rows are prepared and counted, and faults and rows are read after that."""
    calls = tmp_path / "calls"

    def counted():
        encode = quantiser()

        def run(samples):
            with calls.open("a") as f:
                f.write("x")
            if len(samples) == 12000:
                raise ValueError("short")
            return encode(samples)

        return run

    rows = [("m", k, f"{n}.wav", n) for k, n in enumerate(["good", "none", "broken", "stereo", "none"])]
    df = spark.createDataFrame(rows, "file string, pos long, audio string, text string")
    tokenise = lambda d: models.apply_tokenizer(d, lambda: lambda t: [len(t)])
    for inventory in (audio_files.audio_inventory(spark, folder), None):
        calls.write_text("")
        done = training.prepare_manifest(df, inventory, training.encode_files(counted), tokenise, folder)
        assert done.rows.count() == 2 and len(done.faults.collect()) == 4 and done.rows.count() == 2
        assert calls.read_text() == "xxx"
        assert done.funnel["audio_found"] == 3 and done.funnel["failed_rows"] == 1
        told = {(r.text, r.step, r.error, r.trained) for r in done.faults.collect()}
        assert ("good", "encode", "short", False) in told and ("none", "find", "missing_file", False) in told
        calls.write_text("")
        assert tuple(training.stage_funnel(df, inventory, training.encode_files(counted), folder).first()) == (5, 3, 2, 2, 2)
        assert calls.read_text() == "xxx"


def test_nothing_to_prepare(spark, folder):
    none = spark.createDataFrame([], "file string, pos long, audio string, text string")
    tokenise = lambda d: models.apply_tokenizer(d, lambda: lambda t: [len(t)])
    empty = audio_files.audio_inventory(spark, folder).filter("false")
    some = spark.createDataFrame([("m", 0, "good.wav", "x")], none.schema)
    for rows, inventory, n in ((none, empty, 0), (some, empty, 1), (none, None, 0)):
        done = training.prepare_manifest(rows, inventory, training.encode_files(quantiser), tokenise, folder)
        assert done.rows.count() == 0 and done.faults.count() == n
        assert done.funnel["manifest_rows"] == n and done.funnel["codes_not_null"] == 0


@pytest.mark.parametrize("budget", [1, 30_000, 10**9])
def test_encoder_in_batches_of_files(spark, folder, budget):
    names = ["good", "none", "broken", "stereo", "good"]
    df = spark.createDataFrame([(k, f"{folder}/{n}.wav") for k, n in enumerate(names)], "k int, path string")

    def many():
        encode = quantiser()
        return lambda sounds: [encode(x) for x in sounds]

    for on_error in ("silence", "null"):
        single = training.encode_files(quantiser, on_error=on_error)(df)
        together = training.encode_files(many, on_error=on_error, budget=budget)(df)
        assert sorted(map(str, single.collect())) == sorted(map(str, together.collect()))


def test_audit_of_the_first_texts_under_the_cap(spark):
    rows = [("m", n, f"{n}.wav", "a b" if n < 2 else "c") for n in range(5)]
    df = spark.createDataFrame(rows, "file string, pos long, audio string, text string")
    known = spark.createDataFrame([("a",)], "token string")
    row = training.audit(df, known, max_samples=3).first()
    assert (row.total_texts_analyzed, row.total_tokens, row.unk_tokens) == (3, 5, 3)


def test_table_flow_uses_each_rows_own_rate(spark):
    rows = [("ann", "a", SINE.tolist(), 16000), ("bob", "b", SINE.tolist(), 24000)]
    df = spark.createDataFrame(rows, "source string, text string, s array<float>, r int")
    made = tables.rows_to_table(df, F.col("text"), F.col("s"), F.col("r"))
    coded = training.encode_samples(quantiser)(made)
    assert {r.text: len(r.codes) for r in coded.collect()} == {"a": 7 * 1715, "b": 7 * 1143}


def test_generated_flow(spark):
    frame = [128266 + k * 4096 + 3000 for k in range(7)]
    rows = [(0, [1, 128257, *frame, 128258]), (1, [1, 2])]
    df = spark.createDataFrame(rows, "idx int, ids array<int>")
    decode = lambda d: models.apply_decoder(d, dequantiser)
    named = generation.name_outputs(generation.generated_audio(df, decode), "out")
    got = {r.path: r.samples for r in named.collect()}
    assert got["out/generated_audio_001.wav"] == pytest.approx([3000 / 2047.5 - 1] * 7)
    assert got["out/generated_audio_002.wav"] == [0.0] * 1000


def test_line_batch_leaves_a_gap_for_a_failed_line(spark):
    df = spark.createDataFrame([("k", "one\n\nbad\nthree words")], "k string, text string")
    tokenise = lambda d: models.apply_tokenizer(d, lambda: lambda t: [len(t)]).drop("error")

    def fails_on_bad():
        def generate(ids, text):
            if text == "bad":
                raise ValueError
            return ids

        return generate

    generate = lambda d: models.apply_generator(d, fails_on_bad, ["input_ids", "text"])
    decode = lambda d: models.apply_decoder(d, dequantiser)
    out, faults = generation.line_batch(df, "k", "text", tokenise, generate, decode, "/out")
    assert [(r.k, r.idx, r.text, r.step, r.error) for r in faults.collect()] == [("k", 1, "bad", "generate", "ValueError")]
    assert sorted(r.path for r in out.collect()) == [
        "/out/k/batch_001_one.wav", "/out/k/batch_003_three_words.wav",
    ]


def test_ingest_reads_as_the_batch_reader_does(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    (landed / "a.csv").write_text('uuid,sentence\na.wav,"hi, there"\n')
    (landed / "b.csv").write_text('sentence,uuid\n"one\ntwo",b.wav\n')
    (landed / "c.csv").write_text("uuid,sentence\nc.wav,x, y\nd.mp3,z\n")
    paths = [str(landed), str(tmp_path / "taken"), str(tmp_path / "marks")]
    incremental_ingest(spark, *paths, files_per_trigger=2).awaitTermination()
    taken = spark.read.parquet(paths[1]).filter("reason is null").select("audio", "text")
    rows, _ = read_manifest(spark, str(landed))
    want = [("a.wav", "hi, there"), ("b.wav", "one\ntwo"), ("c.wav", "x, y")]
    assert sorted(map(tuple, taken.collect())) == want
    assert sorted((r.audio, r.text) for r in rows.collect()) == want


def test_ingest_takes_each_file_once(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    paths = [str(landed), str(tmp_path / "taken"), str(tmp_path / "marks")]
    seen = []
    for text in ["uuid,sentence\na.wav,x, y\nb.mp3,z\n", "c.wav,w\n\nd.wav\n"]:
        (landed / f"m{len(seen)}.csv").write_text(text)
        incremental_ingest(spark, *paths).awaitTermination()
        taken = spark.read.parquet(paths[1])
        seen.append(sorted((r.audio, r.reason) for r in taken.collect()))
    assert seen[0] == [("a.wav", None), ("b.mp3", "bad_extension")]
    assert seen[1] == [*seen[0], ("c.wav", None), ("d.wav", "no_comma")]


def test_ingest_writes_compact_tables(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.csv").write_text("uuid,sentence\na.wav,one\n")
    incremental_ingest(spark, str(source), str(target), str(tmp_path / "marks")).awaitTermination()
    assert [f.name for f in target.rglob("*.parquet") if ".zstd." not in f.name] == []
    assert [r.audio for r in spark.read.parquet(str(target)).collect()] == ["a.wav"]


def test_ingest_writes_lines_only_into_its_target(spark, tmp_path):
    import random
    from pathlib import Path

    from speechprep.session import shared_dir

    pick = random.Random(3)
    known = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=pick.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(pick.choices(known, k=150)) for _ in range(3000)]
    landed, target = tmp_path / "landed", tmp_path / "taken"
    landed.mkdir()
    for n in range(2):
        kept = [f'{k}.wav,"{t}\n{t[:9]}"' if n else f"{k}.wav,{t}" for k, t in enumerate(texts)]
        (landed / f"m{n}.csv").write_text("\n".join(["uuid,sentence", *kept, "bad.wav"]) + "\n")
    held = lambda folder: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    shared = Path(shared_dir(spark)) / "speechprep"
    before = held(shared)
    incremental_ingest(spark, str(landed), str(target), str(tmp_path / "marks"), files_per_trigger=1).awaitTermination()
    source = sum(f.stat().st_size for f in landed.iterdir())
    assert held(shared) - before < 0.1 * source
    taken = spark.read.parquet(str(target))
    assert taken.groupBy("ok").count().orderBy("ok").collect() == [("false", 2), ("true", 6000)]
    # Whole lines and texts are there, and smaller than the writer's own zstd makes them.
    assert taken.filter("ok = 'true' and (line is null or not contains(line, text))").count() == 0
    plain = tmp_path / "plain"
    taken.write.partitionBy("batch_id", "ok").option("compression", "zstd").parquet(str(plain))
    assert held(target) < held(plain)


def test_long_rows_become_python_values_by_pieces(spark, monkeypatch):
    import pyarrow as pa

    texts = pa.array(["x" * 300_000, None, "y"] * 40)
    parts = [some for (some,) in models.pieces((texts,))]
    assert len(parts) > 2 and pa.concat_arrays(parts).equals(texts)
    assert all(sum(len(t or "") for t in part.to_pylist()[:-1]) < models.BYTES_AT_ONCE for part in parts)
    assert [len(some) for some, _ in models.pieces((pa.array(range(2500)), pa.array([[1]] * 2500)))] == [1024, 1024, 452]
    assert list(models.pieces((pa.array([], pa.string()),))) == []
    monkeypatch.setattr(models, "BYTES_AT_ONCE", 1)
    df = spark.createDataFrame([(n, "a b " * n or None) for n in range(9)], "n int, text string").coalesce(1)
    known = spark.createDataFrame([("a", 4)], "token string, id int")
    got = {r.n: r.text_ids for r in vocab.tokenise(df, known, special=False).collect()}
    assert got == {n: [4, 0] * n if n else None for n in range(9)}


def test_slots_are_walked_by_stretches_of_rows(spark, monkeypatch):
    from speechprep.functions import slots

    df = spark.createDataFrame([(n, [128266 + 4096 * k + n for k in range(n % 9)] if n % 4 else None) for n in range(50)], "n int, ids array<int>")
    told = lambda: {r.n: r.c for r in df.coalesce(1).select("n", slots.in_slot_codes("ids").alias("c")).collect()}
    whole = told()
    monkeypatch.setattr(slots, "ROWS_AT_ONCE", 3)
    assert told() == whole and sum(c is None for c in whole.values()) == 13


def test_numpy_results_go_to_arrow_as_the_numbers_asked_for():
    import numpy as np
    import pyarrow as pa

    kind = pa.struct([("codes", pa.list_(pa.int32())), ("fault", pa.string())])
    made = models._narrowed({"codes": np.arange(3), "fault": None}, kind)
    assert made["codes"].dtype == np.int32 and pa.array([made], kind).to_pylist() == [{"codes": [0, 1, 2], "fault": None}]
    with pytest.raises(pa.ArrowInvalid):
        models._narrowed(np.array([2**40]), pa.list_(pa.int32()))


def test_codes_are_interleaved_where_files_are_read(spark, folder):
    import random

    from speechprep.functions.codes import interleaved
    from speechprep.operators.frames import interleave
    from speechprep.plans.training import encode_files

    pick = random.Random(3)
    rows = [[[pick.randrange(4096) for _ in range(pick.randrange(n * 4))] for n in (1, 2, 4)] for _ in range(60)]
    rows += [[[1], [2, 3], [4, None, 5, 6]], [None, [1], [2]], [[], [], []], [[1], [2], [3, 4, 5, 6]]]
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "k int, l1 array<int>, l2 array<int>, l3 array<int>")
    for r in interleave(df).collect():
        got = interleaved(*rows[r.k])
        assert r.codes == (None if got is None else list(got))
    coded = encode_files(lambda: lambda x: ([1], [2, 3], [4, 5, 6, 7]))(spark.createDataFrame([("/none.wav",)], "path string"))
    assert "lambda" not in coded._jdf.queryExecution().toString()
    assert [len(r.codes) for r in coded.collect()] == [7]
