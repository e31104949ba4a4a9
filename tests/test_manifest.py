"""Manifest parsing by hand cases, on real files."""

import random

import pytest
from pyspark.sql import functions as F

from speechprep.functions.text import WHITESPACE, join_path, strip, words
from speechprep.operators.rows import cap_rows, existing_audio, missing_audio, row_index
from speechprep.sources.manifest import bind_columns, read_lines, read_manifest, read_strict


def manifest(spark, tmp_path, *files, **options):
    for n, text in enumerate(files):
        (tmp_path / f"m{n}.csv").write_bytes(text.encode())
    rows, rejects = read_manifest(spark, str(tmp_path), **options)
    kept = [(r.audio, r.text) for r in rows.orderBy("file", "pos").collect()]
    return kept, sorted((r.line, r.reason) for r in rejects.collect())


def test_loose_lines(spark, tmp_path):
    text = "\n".join(
        ["uuid,sentence", "a.wav,xin, ban", 'b.wav,"x, y"', "", "  c.WAV , z ", "d.mp3,x"]
        + ["e.wav", "f.wav,", ",text", "   "]
    )
    kept, rejects = manifest(spark, tmp_path, text)
    assert kept == [("a.wav", "xin, ban"), ("b.wav", '"x, y"'), ("c.WAV", "z")]
    assert rejects == [
        (",text", "empty_field"),
        ("d.mp3,x", "bad_extension"),
        ("e.wav", "no_comma"),
        ("f.wav,", "empty_field"),
    ]


def test_well_formed_file_is_read_strictly(spark, tmp_path):
    text = 'uuid,sentence\na.wav,"x, y"\nb.mp3,NA\nc.wav\nd.wav,\ne.wav,"say ""hi"""\n'
    kept, rejects = manifest(spark, tmp_path, text)
    assert kept == [("a.wav", "x, y"), ("b.mp3", "NA"), ("e.wav", 'say "hi"')]
    assert rejects == [("c.wav", "empty_field"), ("d.wav,", "empty_field")]


@pytest.mark.parametrize("bad", ["c.wav,x,y", "c.wav,x,", 'c.wav,"open'])
def test_one_faulty_row_sends_the_whole_file_to_the_fallback(spark, tmp_path, bad):
    good = 'uuid,sentence\na.wav,"x, y"\n'
    kept, _ = manifest(spark, tmp_path, good + bad + "\n", good)
    assert kept[0] == ("a.wav", '"x, y"') and kept[1] == tuple(bad.split(",", 1))
    assert kept[2] == ("a.wav", "x, y")


def test_byte_order_mark_and_line_ends(spark, tmp_path):
    kept, rejects = manifest(spark, tmp_path, "﻿uuid,sentence\r\na.wav,x, y\r\n")
    assert kept == [("a.wav", "x, y")] and rejects == []


def test_first_line_rules(spark, tmp_path):
    kept, rejects = manifest(
        spark,
        tmp_path,
        "a.wav,x, y\nb.wav,z\n",  # no header: data
        "sentence,uuid\na.wav,x, y\n",  # swapped header: a bad name
        "a.wav,\nb.wav,\n",  # an empty text passes on the first line only
        "nothing\nb.wav,z, z\n",  # dropped without being counted
        mode="first_comma",
    )
    assert kept == [
        ("a.wav", "x, y"), ("b.wav", "z"), ("a.wav", "x, y"), ("a.wav", ""), ("b.wav", "z, z"),
    ]
    assert rejects == [("b.wav,", "empty_field"), ("sentence,uuid", "bad_extension")]


def test_named_columns_in_any_order(spark, tmp_path):
    text = "speaker,words,file\nann,hello,a.wav\nbob,,b.wav\n"
    kept, rejects = manifest(
        spark, tmp_path, text, text="words", audio="file", columns=["speaker", "words", "file"]
    )
    assert kept == [("a.wav", "hello")] and rejects == [("bob,,b.wav", "empty_field")]


def test_strict_reader_with_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "m.csv").write_text('uuid,sentence\na.wav,"x,\ny"\nb.wav,z\n')
    rows = read_strict(spark, str(tmp_path), ["uuid", "sentence"], multiline=True)
    bound = bind_columns(rows, "sentence", "uuid").orderBy("audio").collect()
    assert [(r.audio, r.text) for r in bound] == [("a.wav", "x,\ny"), ("b.wav", "z")]


def test_headers_of_all_kinds(spark, tmp_path):
    kept, rejects = manifest(
        spark,
        tmp_path,
        '"uuid","sentence"\n"a.wav","hi, there"\n',
        "uuid,sentence,speaker\nb.wav,hi there,bob\n",
        'sentence,uuid\n"one, two",c.wav\n,d.wav\n',
        'speaker,uuid,sentence\nann,e.wav,"one\n\ntwo, ""three"""\nbob,f.wav,four\nbob,g.wav,\n',
        'uuid,sentence\nh.wav,"one\ntwo"\ni.wav,x,y\n',
        '\ufeff"sentence","uuid"\n"x, y","j.wav"\n',
        "uuid,other\nk.wav,x\n",
    )
    assert kept == [
        ("a.wav", "hi, there"), ("b.wav", "hi there"), ("c.wav", "one, two"),
        ("e.wav", 'one\n\ntwo, "three"'), ("f.wav", "four"),
        ("h.wav", '"one'), ("i.wav", "x,y"), ("j.wav", "x, y"), ("k.wav", "x"),
    ]
    assert rejects == [
        (",d.wav", "empty_field"), ("bob,g.wav,", "empty_field"), ('two"', "no_comma"),
        ("uuid,other", "bad_extension"),
    ]


def test_names_that_need_coding_in_paths(spark, tmp_path):
    folder = tmp_path / "a b+c%20d"
    folder.mkdir()
    (folder / "m.csv").write_text('uuid,sentence\na.wav,"x\ny"\n')
    rows, _ = read_manifest(spark, str(folder))
    assert [(r.audio, r.text) for r in rows.collect()] == [("a.wav", "x\ny")]


def test_cap_keeps_file_order_over_many_blocks(spark, tmp_path):
    lines = [f"f{n}.wav,text {n}, end" for n in range(5000)]
    (tmp_path / "m.csv").write_text("uuid,sentence\n" + "\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows, _ = read_manifest(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 3
        capped = cap_rows(rows, 1234, "file", "pos")
        assert {r.audio for r in capped.collect()} == {f"f{n}.wav" for n in range(1234)}
        numbered = row_index(rows, "file", "pos")
        assert all(r.audio == f"f{r.idx}.wav" for r in numbered.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_cap_comes_before_the_file_check(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, pos int")
    there = spark.createDataFrame([("a",), ("c",), ("c",)], "path string")
    capped = cap_rows(rows, 2, "pos")
    assert [r.path for r in existing_audio(capped, there).collect()] == ["a"]
    assert [r.path for r in missing_audio(capped, there).collect()] == ["b"]
    assert cap_rows(rows, 0, "pos").count() == 0 and cap_rows(rows, None).count() == 3
    assert cap_rows(rows, 99, "pos").count() == 3


@pytest.mark.parametrize("parts", [1, 8])
def test_row_index_is_dense(spark, parts):
    df = spark.range(1000).selectExpr("id", "id % 3 as hot").repartition(parts)
    got = {r.id: r.idx for r in row_index(df, "hot", "id").collect()}
    want = sorted(range(1000), key=lambda i: (i % 3, i))
    assert got == {i: n for n, i in enumerate(want)}
    assert row_index(df.filter("id < 0"), "id").count() == 0


@pytest.mark.parametrize("ordered", [3, 10_000])
def test_cap_finds_the_cut(spark, monkeypatch, ordered):
    """By rounds of pivots, with ties and nulls: exactly n rows, the first of the order."""
    monkeypatch.setattr("speechprep.operators.rows.ORDERED", ordered)
    monkeypatch.setattr("speechprep.operators.rows.PIVOTS", 7)
    df = spark.range(900).selectExpr("if(id % 10 = 0, null, id % 7) as a", "if(id < 500, 0, id) as b", "id").repartition(5)
    rows = sorted((tuple((x is not None, x or 0) for x in (r.a, r.b)) for r in df.collect()))
    for n in (1, 2, 89, 90, 91, 333, 500, 899, 900, 901):
        got = cap_rows(df, n, "a", "b").collect()
        assert len(got) == min(n, 900)
        assert sorted(tuple((x is not None, x or 0) for x in (r.a, r.b)) for r in got) == rows[:n]
    assert {r.id for r in cap_rows(df, 321, "id").collect()} == set(range(321))
    assert cap_rows(df.filter("false"), 5, "id").count() == 0


def test_cap_moves_and_writes_nothing(spark, monkeypatch):
    monkeypatch.setattr("speechprep.operators.rows.ORDERED", 10)
    capped = cap_rows(spark.range(5000), 1234, "id")
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert capped.count() == 1234 and "Exchange" not in plan and "Sort" not in plan


def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


def test_quoted_line_breaks_are_read_by_many_tasks(spark, tmp_path):
    """One large quoted file, cut into many blocks: the rows of Spark's multi-line reader."""
    draw = random.Random(9)
    bits = ["x", "\n", "\n\n", ",", '""', " ", "word", "\r\n", "ü漢", '"",""', "a\nb"]
    lines = ["uuid,sentence,who"]
    for k in range(800):
        text = "".join(draw.choices(bits, k=draw.choice([0, 1, 5, 60])))
        lines.append(f'{k}.wav,"{text}",' + draw.choice(["bob", "", '""', '"x\ny"']))
    (tmp_path / "m.csv").write_bytes(("\ufeff" + "\n".join(lines) + "\n").encode())
    columns = ["uuid", "sentence", "who"]
    schema = ", ".join(f"{c} string" for c in columns)
    want = spark.read.schema(schema).options(header=True, escape='"', multiLine=True).csv(str(tmp_path)).collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    small_blocks(spark)
    try:
        assert read_lines(spark, str(tmp_path), "\n").rdd.getNumPartitions() > 20
        got = read_strict(spark, str(tmp_path), columns, multiline=True)
        assert got.filter("_bad is not null").count() == 0
        assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want)) and len(want) == 800
        rows, rejects = read_manifest(spark, str(tmp_path))
        kept = {(r.audio, r.text) for r in rows.collect()}
        assert kept == {(r.uuid, r.sentence) for r in want if r.sentence}
        assert rejects.count() == sum(not r.sentence for r in want)
        ordered = [int(r.audio.split(".")[0]) for r in rows.orderBy("file", "pos").collect()]
        assert ordered == sorted(ordered)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_strict_reader_marks_records_of_other_widths(spark, tmp_path):
    (tmp_path / "m.csv").write_text('uuid,sentence\na.wav,"x\ny",z\n\nb.wav\nc.wav,"q"\n')
    got = read_strict(spark, str(tmp_path), ["uuid", "sentence"], multiline=True).orderBy("uuid").collect()
    assert [(r.uuid, r.sentence, r._bad) for r in got if r._bad is None] == [("c.wav", "q", None)]
    assert sorted(r._bad for r in got if r._bad) == ['a.wav,"x\ny",z', "b.wav"]


def test_text_helpers(spark):
    samples = [f"{w}a{w} b{w}" for w in WHITESPACE] + ["", " ", "x"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    for r in df.select("t", strip(F.col("t")).alias("s"), words(F.col("t")).alias("w")).collect():
        assert r.s == r.t.strip() and r.w == r.t.split()
    names = spark.createDataFrame([("a.wav",), ("/x/a.wav",)], "n string")
    for folder, want in [("/d", "/d/a.wav"), ("/d/", "/d/a.wav"), ("", "a.wav")]:
        got = [r[0] for r in names.select(join_path(folder, F.col("n"))).collect()]
        assert got == [want, "/x/a.wav"]


@pytest.mark.parametrize("broken", [False, True])
def test_whole_lines_are_written_few_times(spark, tmp_path, broken):
    from pathlib import Path

    from speechprep.session import shared_dir
    from speechprep.sources.manifest import parse_manifest

    pick = random.Random(7)
    text = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz0123456789+-", k=2000)) for _ in range(1000)]
    rows = [f'{n}.wav,"{t[:1000]}{chr(10) if broken else " "}{t[1000:]}"' for n, t in enumerate(text)]
    source = tmp_path / "m.csv"
    source.write_text("\n".join(["uuid,sentence", *rows]) + "\n")
    folder = Path(shared_dir(spark)) / "speechprep"
    held = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = held()
    parsed = parse_manifest(spark, str(source)).filter("reason is null")
    assert sorted(int(r.audio.split(".")[0]) for r in parsed.select("audio").collect()) == list(range(1000))
    # Lines once; with line breaks in fields also as read again, with their record's place, and put together.
    assert held() - before < (4 if broken else 1) * source.stat().st_size


@pytest.mark.parametrize("broken", [False, True])
def test_lines_are_not_written_to_parse_them(spark, tmp_path, broken):
    from pathlib import Path

    from speechprep.session import shared_dir
    from speechprep.sources.manifest import parse_manifest

    pick = random.Random(11)
    text = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz0123456789+-", k=2000)) for _ in range(500)]
    rows = [f'{n}.wav,"{t[:1000]}{chr(10) if broken else " "}{t[1000:]}"' for n, t in enumerate(text)]
    source = tmp_path / "m.csv"
    source.write_text("\n".join(["uuid,sentence", *rows]) + "\n")
    folder = Path(shared_dir(spark)) / "speechprep"
    held = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = held()
    assert parse_manifest(spark, str(source)).filter("reason is null").count() == 500
    assert held() - before < 0.1 * source.stat().st_size


def test_lines_read_again_have_the_same_places(spark, tmp_path):
    """Whatever blocks files are cut into by the time of a later job."""
    (tmp_path / "m.csv").write_text("\n".join(f"f{n}.wav,text {n}, end" for n in range(3000)))
    lines = read_lines(spark, str(tmp_path))
    assert lines.sparkSession is spark
    once_read = {r.pos: r.line for r in lines.collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    small_blocks(spark)
    try:
        assert read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20
        assert {r.pos: r.line for r in lines.collect()} == once_read and len(once_read) == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records_longer_than_blocks_and_files_side_by_side(spark, tmp_path):
    """Blocks without the start of a record, texts of bytes that are no characters, many small files."""
    long = "\n".join(f"line {n}" for n in range(600))
    rows = [f'{n}.wav,"{long if n % 3 == 0 else n}"' for n in range(12)]
    (tmp_path / "long.csv").write_text("\n".join(["uuid,sentence", *rows]) + "\n")
    for n in range(9):
        (tmp_path / f"s{n}.csv").write_bytes(b'uuid,sentence\ns%d.wav,"a\n\xff"\n' % n)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for small in (False, True):
        if small:
            small_blocks(spark)
        try:
            rows, rejects = read_manifest(spark, str(tmp_path))
            got = {r.audio: r.text for r in rows.collect()}
            assert got == {f"{n}.wav": long if n % 3 == 0 else str(n) for n in range(12)} | {f"s{n}.wav": "a\n�" for n in range(9)}
            assert rejects.count() == 0
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_out_of_their_blocks_order_are_refused():
    import pyarrow as pa

    from speechprep.sources.manifest import _CUT_LINES, _block_records

    def batch(*rows):
        return pa.RecordBatch.from_pylist([dict(zip(_CUT_LINES, ("f", 0, r, 0, odd, line))) for r, odd, line in rows])

    made = _block_records([batch((0, 0, b"h"), (1, 1, b'a"')), batch((2, 1, b'"b'), (3, 0, b"c"))])
    assert [r["line"] for b in made for r in b.to_pylist()] == [b"h", b'a"\n"b', b"c"]
    with pytest.raises(ValueError):
        list(_block_records([batch((1, 0, b"h"), (0, 1, b"a"))]))
