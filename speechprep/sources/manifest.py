"""Manifests: text lines naming an audio file and its sentence.

A *lines* table has ``file`` (which manifest), ``pos`` (its place there, a number
that grows down the file) and ``line``. ``read_lines`` makes one from text files;
the parsers take any.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_audio_name, strip
from ..operators.funnel import Funnel
from ..operators.models import pieces
from ..operators.once import once
from ..session import fixed_blocks, settled

BAD_EXTENSION = "bad_extension"
NO_COMMA = "no_comma"
EMPTY_FIELD = "empty_field"
MISSING_FILE = "missing_file"
ROW_ERROR = "row_error"
# More than any row number, so that block and row number share one decimal.
ROW_NUMBERS = Decimal(10**19)
RESULTS = ["audio", "text", "reason"]
STRICT, FIRST_COMMA = "strict", "first_comma"
# Tables that hold whole lines are written with it.
TIGHT = "zstd"


def read_lines(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """``(file, pos, line)`` of text files; a byte-order mark is not part of a line.

    Lines end where a text file's lines may end, or only at ``separator``. Files are cut into blocks by the settings
    and cores there are when this is called, so a line has one position in all jobs, and no copy of the lines is needed.
    """
    # A file is read in blocks, and the row numbers grow inside a block. Both in
    # one decimal keep the minimum of positions a hash aggregate.
    block = F.col("_metadata.file_block_start").cast("decimal(38,0)")
    place = block * F.lit(ROW_NUMBERS) + F.monotonically_increasing_id()
    options = {} if separator is None else {"lineSep": separator}
    lines = fixed_blocks(spark).read.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        place.cast("decimal(38,0)").alias("pos"),
        F.col("value").alias("line"),
    )
    # The table on the left says whose session the lines are in; it has no rows, so the plan has no union.
    return spark.sql("select '' as file, cast(0 as decimal(38,0)) as pos, '' as line where false").union(lines)


def quoted_records(lines: DataFrame) -> DataFrame:
    """The lines of ``read_lines`` put together where a quoted field holds line breaks: ``(file, pos, line)``.

    A line starts inside quotes when an odd number of them stands before it in its file. That number is counted
    per block, then over the blocks before, then inside the block, so many tasks share one file. The task that reads a
    block puts its records together; only what a block has of a record begun before it is moved. ``pos`` is the place
    of a record's first line. Lines are to be split at ``\\n`` alone; a ``\\r`` that ends a record is not part of it.
    ``lines`` is read more than once, each block from its first line to its last by one task, as ``read_lines`` does.
    """
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    cut = lines.select(
        "file",
        F.call_function("div", "pos", F.lit(ROW_NUMBERS)).alias("_block"),
        (F.col("pos") % F.lit(ROW_NUMBERS)).cast("long").alias("_row"),
        (quotes % 2).alias("_odd"),
        F.col("line").cast("binary").alias("line"),
    )
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy("file", "_block").agg(F.sum("_odd").alias("_odds"))
    opened = settled(
        blocks.select(
            "file",
            "_block",
            (F.coalesce(F.sum("_odds").over(earlier), F.lit(0)) % 2).cast("int").alias("_before"),
            (F.count("*").over(Window.partitionBy("file")) > 1).alias("_cut"),
        ),
        "quote-parity",
    )
    # Broadcast, so that the lines of a block stay in order in the task that reads them.
    known = cut.join(F.broadcast(opened), ["file", "_block"])
    ends = known.filter("_cut").select(*_CUT_LINES).mapInArrow(_block_ends, "file string, _block long, _last long, _head binary")
    ends = settled(ends.withColumn("_head", F.col("_head").cast("string")), "block-ends", TIGHT)
    started = F.when(F.col("_last").isNotNull(), F.struct(F.col("_block").alias("block"), F.col("_last").alias("row")))
    lent = ends.withColumn("_at", F.last(started, ignorenulls=True).over(earlier)).filter("_head is not null")
    parts = F.array_sort(F.collect_list(F.struct("_block", "_head")))["_head"]
    tails = settled(
        lent.groupBy("file", F.col("_at.block").alias("_block"), F.col("_at.row").alias("_row"))
        .agg(F.array_join(parts, "\n").alias("_tail")),
        "record-tails",
        TIGHT,
    )
    told = known.select(*_CUT_LINES).mapInArrow(_block_records, "file string, _block long, _row long, line binary")
    whole = F.concat_ws("\n", F.col("line").cast("string"), "_tail")
    place = F.col("_block").cast("decimal(38,0)") * F.lit(ROW_NUMBERS) + F.col("_row")
    return told.join(tails, ["file", "_block", "_row"], "left").select(
        "file", place.cast("decimal(38,0)").alias("pos"), F.regexp_replace(whole, "\r$", "").alias("line")
    )


_CUT_LINES = ["file", "_block", "_row", "_before", "_odd", "line"]
# Records of so many bytes, or so many of them, leave a task at once.
BYTES_OUT, ROWS_OUT = 1 << 20, 4096


def _block_lines(batches):
    """``(file, block, row, first, inside, line)``: whether a line is its block's first, and starts inside quotes."""
    at, last, inside = None, None, 0
    for batch in batches:
        for some in pieces([batch.column(name) for name in _CUT_LINES]):
            for file, block, row, before, odd, line in zip(*(values.to_pylist() for values in some)):
                first = (file, block) != at
                if first:
                    at, inside = (file, block), before
                elif row != last + 1:
                    raise ValueError(f"lines of {file} are not in the order of their block")
                yield file, block, row, first, bool(inside), line
                last, inside = row, inside ^ odd


def _block_records(batches):
    """The records that start in a block, as far as the block holds them."""
    import pyarrow as pa

    kind = pa.schema([("file", pa.string()), ("_block", pa.int64()), ("_row", pa.int64()), ("line", pa.binary())])
    made, size, parts, place = [], 0, None, None

    def sent():
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*made), kind)], schema=kind)

    for file, block, row, first, inside, line in _block_lines(batches):
        if first or not inside:
            if parts is not None:
                made.append((*place, b"\n".join(parts)))
                size += len(made[-1][-1])
                if size >= BYTES_OUT or len(made) >= ROWS_OUT:
                    yield sent()
                    made, size = [], 0
            parts, place = None if inside else [line], (file, block, row)
        elif parts is not None:
            parts.append(line)
    if parts is not None:
        made.append((*place, b"\n".join(parts)))
    if made:
        yield sent()


def _block_ends(batches):
    """Of each block, the row where its last record starts, and what it has of a record begun before it."""
    import pyarrow as pa

    kind = pa.schema([("file", pa.string()), ("_block", pa.int64()), ("_last", pa.int64()), ("_head", pa.binary())])

    def sent(file, block, start, head):
        line = b"\n".join(head) if head else None
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((file, block, start, line), kind)], schema=kind)

    at = None
    for file, block, row, first, inside, line in _block_lines(batches):
        if first:
            if at:
                yield sent(*at, start, head)
            at, start, head = (file, block), None, []
        if not inside:
            start = row
        elif start is None:
            head.append(line)
    if at:
        yield sent(*at, start, head)


def classify_first_comma(lines: DataFrame, is_first: Column, header: str) -> DataFrame:
    """Add ``audio``, ``text`` and ``reason`` by the first-comma rule.

    ``reason`` is null for a kept line, ``skip`` for a line that is dropped
    without being counted (blank, header, first line without comma), and the
    name of the fault otherwise. A first line may have an empty text.
    """
    whole = strip(F.col("line"))
    cut = F.split(whole, ",", 2)
    audio, text = F.col("audio"), F.col("text")
    no_comma = text.isNull()
    reason = (
        F.when((F.col("_whole") == "") & ~F.col("_first"), "skip")
        .when(F.col("_first") & (no_comma | (F.col("_whole") == header)), "skip")
        .when(no_comma, NO_COMMA)
        .when(~F.col("_first") & ((audio == "") | (text == "")), EMPTY_FIELD)
        .when(~is_audio_name(audio), BAD_EXTENSION)
    )
    split = once(lines, _whole=whole, _cut=cut, _first=is_first)
    fields = once(split, audio=strip(F.get("_cut", 0)), text=strip(F.get("_cut", 1)))
    return once(fields, reason=reason).drop("_whole", "_cut", "_first")


def classify_strict(lines: DataFrame, width: int) -> DataFrame:
    """Add ``audio``, ``text`` and ``reason`` by CSV rules, quoted commas included.

    Lines carry what their file's header says: ``fields`` (how many there are), ``audio_at`` and
    ``text_at`` (places from 1). No file has more than ``width`` fields. Only an empty field is null.
    """
    split = once(_split(lines, F.col("line"), width), _count=_field_count())
    return _strict_fields(split).drop("_parts", "_count")


def _strict_fields(split: DataFrame) -> DataFrame:
    count = F.col("_count")
    at = lambda place: F.when(F.col(place) <= count, F.get("_parts", F.col(place) - 1))
    fields = once(split, audio=at("audio_at"), text=at("text_at"))
    reason = (
        F.when(F.col("is_first") | (strip(F.col("line")) == ""), "skip")
        .when((count < 0) | (count > F.col("fields")), ROW_ERROR)
        .when(_empty("audio") | _empty("text"), EMPTY_FIELD)
    )
    return once(fields, reason=reason)


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name) == "", F.lit(True))


# Put behind each line before it is split, it shows where the line's fields end.
_END = "\x01end"
# A first line with more fields than this is no header.
MAX_COLUMNS = 1_000


def _columns(width: int) -> str:
    return ", ".join(f"c{n} string" for n in range(width + 1))


def _array(width: int, prefix: str = "") -> Column:
    return F.array(*[F.col(f"{prefix}c{n}") for n in range(width + 1)])


def _split(df: DataFrame, line: Column, width: int) -> DataFrame:
    """Add ``_parts``: the fields of a line by CSV rules, up to ``width``, and the end mark."""
    closed = F.concat(line, F.lit("," + _END))
    options = {"mode": "PERMISSIVE", "escape": '"', "multiLine": "true"}
    fields = F.from_csv(closed, _columns(width), options)
    return once(once(df, _fields=fields), _parts=_array(width, "_fields.")).drop("_fields")


def _field_count() -> Column:
    """Fields of ``_parts``; -1 when the end mark is lost behind too many fields or inside an open quote."""
    return F.array_position("_parts", F.lit(_END)).cast("int") - 1


def first_places(lines: DataFrame) -> DataFrame:
    """``(file, first_pos)``, a written table."""
    return settled(lines.groupBy("file").agg(F.min("pos").alias("first_pos")), "first-places")


def file_headers(
    lines: DataFrame, text: str, audio: str, columns: list[str] | None = None, firsts: DataFrame | None = None
) -> tuple[DataFrame, int]:
    """``(file, first_pos, fields, audio_at, text_at, named)`` of each file, and the widest header's fields.

    The first line, split by CSV rules, is the header when it names both columns, in any order and among
    others. ``columns`` stand in for one without the names. ``firsts`` are the ``first_places``, where they are known.
    Jobs run when called; only the width comes to the driver.
    """
    firsts = first_places(lines) if firsts is None else firsts
    heads = (
        lines.join(firsts, "file")
        .filter(F.col("pos") == F.col("first_pos"))
        .select("file", "first_pos", strip(F.col("line")).alias("header"))
    )
    width = F.size(F.split("header", ","))
    may_name = F.col("header").contains(audio) & F.col("header").contains(text) & (width <= MAX_COLUMNS)
    widest = Funnel()
    heads = settled(widest.watch(heads, most=F.max(F.when(may_name, width))), "headers")
    most = max(widest.counts().get("most") or 1, len(columns or []))
    named = once(_split(heads, F.col("header"), most), _count=_field_count())
    named = once(named, _names=F.slice("_parts", 1, F.greatest("_count", F.lit(0))))
    place = lambda name: F.array_position("_names", F.lit(name)).cast("int")
    found = (place(audio) > 0) & (place(text) > 0)
    if columns:
        given = F.array(*[F.lit(c) for c in columns])
        named = once(named, _names=F.when(found, F.col("_names")).otherwise(given))
    headed = named.select(
        "file", "first_pos", F.size("_names").alias("fields"),
        place(audio).alias("audio_at"), place(text).alias("text_at"), found.alias("named"),
    )
    return headed, most


def parse_lines(
    lines: DataFrame,
    text: str = "sentence",
    audio: str = "uuid",
    mode: str = "auto",
    columns: list[str] | None = None,
) -> DataFrame:
    """Every line with ``audio``, ``text``, ``reason``, ``is_first`` and ``strict``.

    ``mode`` is ``auto`` (each file by its own verdict), ``strict`` or ``first_comma``. A table of lines
    cannot be read again with line breaks in its fields; ``read_manifest`` does that.
    """
    parsed, _ = _parsed(lines, text, audio, mode, columns)
    return settled(parsed, "parsed-lines", TIGHT) if mode == "auto" else parsed


def _parsed(
    lines: DataFrame, text: str, audio: str, mode: str, columns: list[str] | None
) -> tuple[DataFrame, DataFrame | None]:
    """As ``parse_lines``, and in ``auto`` mode ``(file, strict, spans)`` of each file, a written table.

    In ``auto`` mode a file whose header names the columns is ``strict`` when no row has more fields than its header and
    no line leaves a quote open. One over-long row sends the whole file to the first-comma rule. With open
    quotes that the file closes again it ``spans``: its fields may hold line breaks.

    The verdicts are summed up while lines are split by CSV rules, and nothing of a line is written for them; lines
    of strict files are split once more when the result is asked for.
    """
    shown = ["file", "pos", "line", *RESULTS, "is_first", "strict"]
    is_first = F.col("pos") == F.col("first_pos")
    plain = f"{audio},{text}"  # the fallback knows only the plain two-column header, audio name first
    if mode == FIRST_COMMA:
        known = lines.join(first_places(lines), "file").withColumn("is_first", is_first)
        known = classify_first_comma(known, F.col("is_first"), plain)
        return known.withColumn("strict", F.lit(False)).select(*shown), None
    headed, width = file_headers(lines, text, audio, columns if mode == STRICT else None)
    known = lines.join(headed, "file").withColumn("is_first", is_first)
    if mode == STRICT:
        return classify_strict(known, width).withColumn("strict", F.lit(True)).select(*shown), None
    # Lines of files without a header are not split by CSV rules, and without a quote a line's commas are all that counts.
    told = F.col("named") & (F.col("line").contains('"') | F.col("line").contains(_END))
    split = once(_split(known, F.when(told, F.col("line")), width), _count=_field_count())
    commas = F.length("line") - F.length(F.replace("line", F.lit(","), F.lit("")))
    open_quote = F.exists("_parts", lambda x: x.endswith(_END) & (x != _END))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    over = F.when(told, (F.col("_count") < 0) | (F.col("_count") > F.col("fields"))).otherwise(commas >= F.col("fields"))
    seen = split.select(
        "file", "named", over.alias("_over"), F.coalesce(open_quote, F.lit(False)).alias("_open"),
        quotes.alias("_quotes"),
    )
    verdicts = seen.groupBy("file").agg(
        F.max(F.when(F.col("named"), F.col("_over"))).alias("_over"),
        F.max(F.col("named") & F.col("_open")).alias("_open"),
        F.sum("_quotes").alias("_quotes"),
    )
    verdicts = settled(
        verdicts.select(
            "file",
            F.coalesce(~F.col("_over"), F.lit(False)).alias("strict"),
            (F.col("_open") & (F.col("_quotes") % 2 == 0)).alias("spans"),
        ),
        "verdicts",
    )
    told = known.join(verdicts.select("file", "strict"), "file")
    split = once(_split(told, F.when(F.col("strict"), F.col("line")), width), _count=_field_count())
    strict = _strict_fields(split).withColumnsRenamed({n: f"_{n}" for n in RESULTS})
    both = classify_first_comma(strict, F.col("is_first"), plain)
    taken = {n: F.when(F.col("strict"), F.col(f"_{n}")).otherwise(F.col(n)) for n in RESULTS}
    return both.withColumns(taken).select(*shown), verdicts


def kept(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).select("file", "pos", "audio", "text")


def rejected(parsed: DataFrame) -> DataFrame:
    """The quarantine: lines that count as faults, with their reason."""
    faults = F.col("reason").isNotNull() & (F.col("reason") != "skip")
    return parsed.filter(faults).select("file", "pos", "line", "reason")


def parse_manifest(
    spark: SparkSession,
    path: str | list[str],
    text: str = "sentence",
    audio: str = "uuid",
    mode: str = "auto",
    columns: list[str] | None = None,
) -> DataFrame:
    """Every row of manifest files as ``parse_lines`` gives them, each file parsed by its own rule.

    Row numbers depend on how files are cut into blocks; ``read_lines`` keeps the cuts for all jobs, so that verdicts,
    caps and order refer to the same positions. Files are read again by each job, and nothing of a line is written.

    Files with line breaks in quoted fields are read once more, and their lines put together to records by the
    quotes before them; only the paths of those files come to the driver.
    """
    lines = read_lines(spark, path)
    parsed, verdicts = _parsed(lines, text, audio, mode, columns)
    if verdicts is None:
        return parsed
    paths = [r.path for r in verdicts.filter("spans").select(_readable(F.col("file")).alias("path")).collect()]
    if not paths:
        return parsed
    again = read_lines(spark, paths, "\n")
    records = quoted_records(again)
    headed, width = file_headers(records, text, audio, firsts=first_places(again))
    known = records.join(headed, "file").withColumn("is_first", F.col("pos") == F.col("first_pos"))
    fields = classify_strict(known, width)
    # A file with an over-long record stays with the first-comma rule.
    over = fields.groupBy("file").agg(F.max(F.coalesce(F.col("reason") == ROW_ERROR, F.lit(False))).alias("_over"))
    whole = settled(over.filter(~F.col("_over")).select("file"), "spanning")
    strict = fields.join(whole, "file", "left_semi").withColumn("strict", F.lit(True))
    return parsed.join(whole, "file", "left_anti").unionByName(strict.select(*parsed.columns))


def _readable(file: Column) -> Column:
    """The path behind a file's URI."""
    return F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))


def read_manifest(
    spark: SparkSession,
    path: str | list[str],
    text: str = "sentence",
    audio: str = "uuid",
    mode: str = "auto",
    columns: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of manifest files; see ``parse_manifest``."""
    parsed = parse_manifest(spark, path, text, audio, mode, columns).filter(F.coalesce(F.col("reason") != "skip", F.lit(True)))
    # Written for both tables; only a fault is shown as the line it stands in.
    line = F.when(F.col("reason").isNotNull(), F.col("line")).alias("line")
    parsed = settled(parsed.select("file", "pos", line, *RESULTS), "parsed-lines", TIGHT)
    return kept(parsed), rejected(parsed)


def read_strict(
    spark: SparkSession, path: str, columns: list[str], multiline: bool = False
) -> DataFrame:
    """CSV files with a header, by place: ``columns`` and ``_bad``, the record where their number is not right.

    ``multiline`` lets quotes span lines; such files are shared by many tasks all the same (``quoted_records``),
    while Spark's own multi-line reader takes each in one. Their quotes are counted when this is called.
    """
    if multiline:
        lines = read_lines(spark, path, "\n")
        records = quoted_records(lines)
        data = records.join(first_places(lines), "file").filter((F.col("pos") != F.col("first_pos")) & (F.col("line") != ""))
        split = once(_split(data, F.col("line"), len(columns)), _count=_field_count())
        fields = [F.get("_parts", F.lit(k)) for k in range(len(columns))]
        return split.select(
            *[F.when(F.col("_count").between(0, len(columns)) & (F.col("_count") <= k), None).otherwise(x).alias(c)
              for k, (c, x) in enumerate(zip(columns, fields))],
            F.when(F.col("_count") != len(columns), F.col("line")).alias("_bad"),
        )
    schema = ", ".join(f"`{c}` string" for c in columns)
    return (
        spark.read.schema(f"{schema}, _bad string")
        .option("header", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .csv(path)
    )


def bind_columns(df: DataFrame, text: str, audio: str) -> DataFrame:
    """Caller-named columns to ``text`` and ``audio``."""
    return df.withColumnsRenamed({text: "text", audio: "audio"})
