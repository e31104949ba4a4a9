"""One query per operator, each over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechprep.constants import (
    AUDIO_OFFSET,
    CODEBOOK,
    FRAME,
    SAMPLE_RATE,
    TRAINING_COLUMNS,
)
from speechprep.functions import audio as audio_fn
from speechprep.functions import codes as codes_fn
from speechprep.functions import sequences as seq_fn
from speechprep.functions import text as text_fn
from speechprep.operators import batching, extraction, frames, models, rows, vocab
from speechprep.operators import audio as audio_op
from speechprep.operators import sequences as seq_op
from speechprep.plans import generation, slicing, training
from speechprep.session import new_table_path
from speechprep.sinks import tables as table_sink
from speechprep.sinks.wavs import write_wavs
from speechprep.sources import audio_files, manifest, tables
from speechprep.sources import prompts as prompt_source
from speechprep.streaming.ingest import incremental_ingest

from .standins import (
    HEADER,
    AUDIO_DIR,
    DOCUMENT,
    document_codes,
    dequantiser,
    echo_batch,
    ints,
    inventory,
    manifest_lines,
    micros,
    named_lines,
    prompts,
    quantiser,
    streams,
    table,
    vocab as vocabulary,
    waveforms,
    with_codes,
    without_top_p,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def position(*keep: str) -> list:
    """Manifest rows with their position as plain columns."""
    document = F.floor(F.col("pos") / DOCUMENT)
    line = F.when(F.col("pos") < 0, 0).otherwise(F.col("pos") % DOCUMENT)
    return ["file", document.alias("doc_id"), line.alias("n"), *keep]


def parsed(spark: SparkSession, sf: str, mode: str = "auto") -> DataFrame:
    return manifest.parse_lines(manifest_lines(spark, sf), mode=mode)


def tokeniser(spark: SparkSession, sf: str, text: str = "prompt", special: bool = True):
    known = vocabulary(spark, sf)
    return lambda df: vocab.tokenise(df, known, text, special=special)


# --- sources -------------------------------------------------------------------


@query
def manifest_strict(spark, sf):
    """Quoted CSV files written from every line, read back by the strict reader."""
    path = new_table_path(spark, "strict")
    lines = named_lines(spark, sf).select(F.col("name").alias("uuid"), "sentence")
    lines.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    read = manifest.read_strict(spark, path, ["uuid", "sentence"], multiline=True)
    return read.filter(F.col("_bad").isNull()).select("uuid", "sentence")


def write_manifests(spark: SparkSession, sf: str) -> str:
    """Folders of manifest files: all fields quoted; other columns in another order; whole texts with
    their line breaks; lines without quotes, where a comma in a sentence makes a row over-long; and the manifest lines
    as they are, faults included, a file for each source."""
    folder = new_table_path(spark, "manifests")
    lines = named_lines(spark, sf).withColumnsRenamed({"name": "uuid"})

    def put(df: DataFrame, kind: str, **options) -> None:
        df.write.options(header=True, escape='"', compression="gzip", **options).csv(f"{folder}/{kind}")

    raw = manifest_lines(spark, sf).repartition("file").sortWithinPartitions("file", "pos")
    raw.select("file", "line").write.partitionBy("file").text(f"{folder}/raw", compression="gzip")
    put(lines.select("uuid", "sentence"), "quoted", quoteAll=True)
    put(lines.select("sentence", "lang", "uuid"), "wide")
    whole = table(spark, sf, "documents").filter("text is not null")
    name = F.format_string("whole_%d.wav", "doc_id")
    put(whole.select("lang", name.alias("uuid"), F.col("text").alias("sentence")), "whole", quoteAll=True)
    plain = lines.filter(F.col("uuid").endswith("wav") & ~F.col("sentence").contains('"'))
    plain = plain.filter((F.col("sentence") != "") & (text_fn.strip(F.col("sentence")) == F.col("sentence")))
    line = F.concat_ws(",", "uuid", "sentence").alias(HEADER)
    put(plain.select(line), "plain", sep="\x01", quote="\x00")
    return f"{folder}/{{quoted,wide,whole,plain,raw/*}}"


def shown_manifest(rows: DataFrame) -> DataFrame:
    kind = F.regexp_extract("file", "/([a-z]+)/(?:file=[^/]*/)?[^/]*$", 1)
    text = F.coalesce("text", F.lit(""))
    return rows.select(kind.alias("kind"), "audio", text.alias("text"), "reason")


@query
def manifest_files(spark, sf):
    """Manifest files with headers of several kinds, read by their own headers."""
    rows = manifest.parse_manifest(spark, write_manifests(spark, sf))
    return shown_manifest(rows.filter(F.coalesce(F.col("reason") != "skip", F.lit(True))))


@query
def manifest_first_comma(spark, sf):
    return manifest.kept(parsed(spark, sf, "first_comma")).select(*position("audio", "text"))


@query
def manifest_header(spark, sf):
    """First lines of each file: header, data or dropped."""
    lines = parsed(spark, sf, "first_comma")
    return lines.filter("is_first").select(
        "file", "line", F.coalesce("reason", F.lit("data")).alias("first_line_is")
    )


@query
def manifest_mode_select(spark, sf):
    return manifest.kept(parsed(spark, sf)).select(*position("audio", "text"))


@query
def prompt_lines(spark, sf):
    """Prompt files written from the conversations, read back without blank lines and numbered."""
    path = new_table_path(spark, "prompts")
    asked = prompts(spark, sf).repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    asked.select("text").write.text(path)
    return prompt_source.prompt_lines(spark, path=path)


@query
def prompt_block_split(spark, sf):
    return prompt_source.split_block(prompts(spark, sf), F.col("text"), ["conv_id", "turn"])


@query
def load_table(spark, sf):
    docs = tables.load_table(spark, f"{sf}/documents.parquet", split="fr", split_column="lang")
    return docs.select("doc_id", "text", tables.sample_rate(docs).alias("sampling_rate"))


@query
def rows_to_table(spark, sf):
    waves = waveforms(spark, sf)
    made = tables.rows_to_table(
        waves, F.col("vec_id").cast("string"), F.col("samples"), F.lit(SAMPLE_RATE)
    )
    return made.select(
        "text", micros(F.col("audio.array")).alias("samples"), "audio.sampling_rate"
    )


def wav_folder(spark: SparkSession, sf: str, stereo: bool = False, rate: int = SAMPLE_RATE):
    """A folder with one WAV file per embedding."""
    folder = new_table_path(spark, "wavs")
    waves = waveforms(spark, sf)
    if stereo:
        half = F.transform("samples", lambda v: (v / 4).cast("float"))
        waves = waves.withColumn("samples", F.array("samples", half))
    name = F.format_string("vec_%d.wav", "vec_id")
    named = waves.withColumn("path", text_fn.join_path(folder, name))
    write_wavs(named, rate=rate).write.format("noop").mode("append").save()
    return folder


def base_name(path: str = "path"):
    return F.substring_index(path, "/", -1).alias("file_name")


@query
def audio_inventory(spark, sf):
    found = audio_files.audio_inventory(spark, wav_folder(spark, sf))
    return found.select(base_name(), "length")


@query
def audio_sizes(spark, sf):
    """Each row asks for its own file."""
    folder = wav_folder(spark, sf)
    name = F.format_string("vec_%d.wav", "doc_id")
    items = table(spark, sf, "documents").select(
        "doc_id", text_fn.join_path(folder, name).alias("path")
    )
    return audio_files.sized(items).select("doc_id", "length")


@query
def audio_decode(spark, sf):
    decoded = audio_files.decode_audio(spark, wav_folder(spark, sf))
    return decoded.select(
        base_name(), micros(F.col("samples")).alias("samples"), "source_rate", "decode_ok"
    )


@query
def pcm_mono(spark, sf):
    decoded = audio_files.decode_audio(spark, wav_folder(spark, sf, stereo=True))
    return decoded.select(base_name(), micros(F.col("samples")).alias("samples"))


@query
def resample(spark, sf):
    """16 kHz waveforms to 24 kHz."""
    up = audio_files.resampler()(F.col("samples"), F.lit(16000))
    coarse = F.transform("up", lambda v: F.floor(v.cast("double") * 1e4 + 0.5))
    waves = waveforms(spark, sf).withColumn("up", up)
    return waves.select("vec_id", ints(coarse).alias("samples"))


# --- sinks ---------------------------------------------------------------------


@query
def write_batches(spark, sf):
    """Slices of ``orders`` written as CSV and read back."""
    path = new_table_path(spark, "slices")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    table_sink.write_batches(orders, path, 2000, "o_orderkey")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, batch_id bigint"
    return spark.read.schema(schema).option("header", True).csv(path)


@query
def write_training_table(spark, sf):
    path = new_table_path(spark, "training")
    table_sink.write_training_table(training_rows(spark, sf), path)
    written = spark.read.parquet(path)
    return written.select(*[ints(F.col(c)).alias(c) for c in TRAINING_COLUMNS])


@query
def write_wavs_report(spark, sf):
    folder = new_table_path(spark, "spoken")
    name = F.format_string("vec_%d.wav", "vec_id")
    named = waveforms(spark, sf).withColumn("path", text_fn.join_path(folder, name))
    return write_wavs(named).select("vec_id", base_name(), "ok", "error")


@query
def output_names(spark, sf):
    named = generation.name_outputs(prompts(spark, sf), "out", "turn")
    orders = table(spark, sf, "orders").withColumn("idx", F.col("o_orderkey"))
    numbered = generation.name_outputs(orders, "out/", prefix="order")
    return named.select("path").union(numbered.select("path"))


@query
def batch_names(spark, sf):
    name = text_fn.batch_name(F.col("turn"), F.col("text"))
    return prompts(spark, sf).select("conv_id", "turn", name.alias("file_name"))


@query
def export_manifest(spark, sf):
    folder = new_table_path(spark, "bundle")
    docs = table(spark, sf, "documents").select(
        text_fn.join_path(folder, F.format_string("doc_%d.wav", "doc_id")).alias("path"),
        F.when(F.col("lang") != "de", audio_fn.silence(10)).alias("samples"),
    )
    return table_sink.export_manifest(write_wavs(docs))


# --- projections and filters -----------------------------------------------------


@query
def bind_columns(spark, sf):
    return manifest.bind_columns(
        named_lines(spark, sf).select("name", "sentence"), text="sentence", audio="name"
    )


@query
def filter_wav(spark, sf):
    lines = named_lines(spark, sf).select("doc_id", "n", "name")
    return lines.filter(text_fn.is_audio_name(F.col("name")))


@query
def filter_nonempty(spark, sf):
    lines = manifest_lines(spark, sf)
    cut = F.split("line", ",", 2)
    both = lines.select(*position(), text_fn.strip(F.get(cut, 1)).alias("text"))
    return both.filter(F.col("text") != "")


@query
def filter_has_codes(spark, sf):
    lines = with_codes(named_lines(spark, sf), "sentence")
    # A one-word line has a single frame; taking it away leaves some rows empty.
    rest = lines.withColumn("codes", F.slice("codes", FRAME + 1, F.size("codes")))
    nulled = rest.withColumn("codes", F.when(F.col("lang") != "de", F.col("codes")))
    return rows.has_codes(nulled).select("doc_id", "n", ints(F.col("codes")).alias("codes"))


@query
def keep_columns(spark, sf):
    docs = table(spark, sf, "documents")
    return rows.keep_columns(docs, ["lang", "doc_id", "absent"])


@query
def drop_on_map(spark, sf):
    docs = table(spark, sf, "documents").drop("n_chars")
    return models.map_rows(docs, count_lines, "lines int", ["text", "source"]).drop("error")


@query
def audio_path(spark, sf):
    lines = named_lines(spark, sf)
    absolute = F.when(F.col("lang") == "fr", F.concat(F.lit("/data/"), "name"))
    name = F.coalesce(absolute, F.col("name"))
    return lines.select("doc_id", "n", text_fn.join_path(AUDIO_DIR, name).alias("path"))


@query
def quarantine(spark, sf):
    return manifest.rejected(parsed(spark, sf)).select(*position("line", "reason"))


@query
def skip_counts(spark, sf):
    """Rejected lines and lines whose file is missing, by reason."""
    lines = parsed(spark, sf)
    path = text_fn.join_path(AUDIO_DIR, F.col("audio"))
    kept = manifest.kept(lines).withColumn("path", path)
    lost = rows.missing_audio(kept, inventory(spark, sf))
    reasons = manifest.rejected(lines).select("reason").union(
        lost.select(F.lit(manifest.MISSING_FILE).alias("reason"))
    )
    return rows.reason_counts(reasons)


@query
def prompt_nonblank(spark, sf):
    lines = named_lines(spark, sf).withColumn(
        "text", F.when(F.col("sentence").contains(" "), F.col("sentence")).otherwise(" \n\t ")
    )
    return prompt_source.nonblank(lines).select("doc_id", "n")


# --- joins ---------------------------------------------------------------------


def placed(spark, sf):
    kept = manifest.kept(parsed(spark, sf))
    return kept.withColumn("path", text_fn.join_path(AUDIO_DIR, F.col("audio")))


@query
def manifest_semi_audio(spark, sf):
    found = rows.existing_audio(placed(spark, sf), inventory(spark, sf))
    return found.select("path", "text")


@query
def manifest_anti_audio(spark, sf):
    lost = rows.missing_audio(placed(spark, sf), inventory(spark, sf))
    return lost.select("path", "text")


@query
def attach_audio(spark, sf):
    """Each row reads its own file; the sizes show which were there."""
    folder = wav_folder(spark, sf)
    items = table(spark, sf, "documents").select("doc_id").withColumn(
        "path", text_fn.join_path(folder, F.format_string("vec_%d.wav", "doc_id"))
    )
    loaded = audio_files.attach_audio(items)
    decoded = audio_files.decoded(loaded, F.col("content"))
    return decoded.select(
        "doc_id",
        F.length("content").alias("bytes"),
        "decode_ok",
        F.size("samples").alias("n_samples"),
    )


@query
def vocab_lookup(spark, sf):
    docs = table(spark, sf, "documents")
    tokens = vocab.tokens_of(docs, "text", "doc_id")
    known = vocab.vocab_lookup(tokens, vocabulary(spark, sf), unk=0)
    return known.select("doc_id", "pos", "id")


@query
def resolve_params(spark, sf):
    asked = prompts(spark, sf).select(
        "conv_id",
        "turn",
        F.when(F.col("voice") == "user", "stable")
        .when(F.col("voice") == "assistant", "expressive")
        .otherwise("unheard_of")
        .alias("preset"),
        F.when(F.col("turn") > 2, F.length("text")).alias("max_new_tokens"),
        F.when(F.length("text") > 500, F.lit(0.3)).alias("temperature"),
    )
    return batching.resolve_params(asked)


# --- aggregation -----------------------------------------------------------------


@query
def vocab_coverage(spark, sf):
    docs = table(spark, sf, "documents")
    report = vocab.vocab_coverage(docs, vocabulary(spark, sf))
    return report.withColumns(
        {c: F.round(c, 6) for c in ("coverage_rate", "avg_tokens_per_text")}
    )


@query
def audit_sample(spark, sf):
    """The audit as it runs before a training round: the first 100 texts."""
    docs = table(spark, sf, "documents")
    first = vocab.audit_sample(docs, "doc_id")
    return vocab.vocab_coverage(first, vocabulary(spark, sf)).drop("coverage_flag").withColumns(
        {c: F.round(c, 6) for c in ("coverage_rate", "avg_tokens_per_text")}
    )


@query
def coverage_flag(spark, sf):
    """Share of known words per language, and whether it is enough."""
    docs = table(spark, sf, "documents")
    tokens = vocab.tokens_of(docs, "text", "lang")
    counted = tokens.groupBy("lang", "token").agg(F.count("*").alias("n"))
    known = vocab.vocab_lookup(counted, vocabulary(spark, sf), unk=0)
    hits = F.sum(F.when(F.col("id") != 0, F.col("n")).otherwise(0))
    rates = known.groupBy("lang").agg((hits / F.sum("n") * 100).alias("rate"))
    return rates.select(
        "lang",
        F.round("rate", 6).alias("rate"),
        text_fn.coverage_flag(F.col("rate")).alias("flag"),
        text_fn.coverage_flag(F.col("rate") + 60).alias("flag_if_60_more"),
    )


@query
def token_counts(spark, sf):
    docs = table(spark, sf, "documents")
    return vocab.token_counts(vocab.tokens_of(docs, "text"))


@query
def top_tokens(spark, sf):
    docs = table(spark, sf, "documents")
    return vocab.top_tokens(vocab.tokens_of(docs, "text", "doc_id"), "doc_id")


@query
def stage_funnel(spark, sf):
    kept = manifest.kept(parsed(spark, sf))
    return training.stage_funnel(kept, inventory(spark, sf), with_codes, AUDIO_DIR)


@query
def frames_removed(spark, sf):
    collapsed = frames.collapse_frames(document_codes(spark, sf))
    return collapsed.agg(
        F.sum("removed").alias("removed"),
        F.sum(F.size("codes") / FRAME).cast("bigint").alias("kept"),
    )


@query
def batch_plan(spark, sf):
    return batching.batch_plan(table(spark, sf, "orders"), 2000, 5000)


# --- windows, order, limits ----------------------------------------------------


@query
def row_index(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    numbered = rows.row_index(orders, "o_orderdate", "o_orderkey")
    return numbered.select("idx", "o_orderkey", "o_custkey")


@query
def frame_runs(spark, sf):
    """Repeats collapsed in long form, over stretches of 64 frames."""
    exploded = frames.explode_frames(document_codes(spark, sf), "doc_id")
    return frames.frame_runs(exploded, "doc_id", stretch=64)


@query
def batch_max_len(spark, sf):
    turns = prompts(spark, sf).withColumn("w", text_fn.words(F.col("text")))
    return batching.batch_max_len(turns, "conv_id", "w")


@query
def batch_crop_pos(spark, sf):
    return extraction.batch_crop_positions(streams(spark, sf), "source", "doc_id")


@query
def cap_rows(spark, sf):
    """The first 5,000 manifest rows in file order."""
    kept = manifest.kept(parsed(spark, sf))
    return rows.cap_rows(kept, 5000, "file", "pos").select(*position("audio", "text"))


@query
def cap_rows_numbered(spark, sf):
    """A cap inside a large table."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return rows.cap_rows(orders, 12_000, "o_orderkey")


# --- scalar and array functions --------------------------------------------------


@query
def speaker_prefix(spark, sf):
    docs = seq_op.speaker_text(table(spark, sf, "documents"))
    return docs.select("doc_id", "prompt")


@query
def voice_prefix(spark, sf):
    return seq_op.voice_text(prompts(spark, sf)).select("conv_id", "turn", "prompt")


@query
def reference_prefix(spark, sf):
    asked = prompts(spark, sf)
    return asked.select("conv_id", "turn", text_fn.reference_prefix(F.col("text")).alias("prompt"))


@query
def tokenise(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = tokeniser(spark, sf, "text")(docs)
    return coded.select("doc_id", ints(F.col("text_ids")).alias("text_ids"))


@query
def tokenise_large_vocab(spark, sf):
    """As for a vocabulary beyond the bound: a dictionary for each slice of the rows."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = vocab.tokenise(docs, vocabulary(spark, sf), max_broadcast=0)
    return coded.select("doc_id", ints(F.col("text_ids")).alias("text_ids"))


@query
def interleave(spark, sf):
    return document_codes(spark, sf).select("doc_id", ints(F.col("codes")).alias("codes"))


@query
def deinterleave(spark, sf):
    """Codes made relative and split back; equal to the layers they came from."""
    coded = document_codes(spark, sf)
    relative = F.transform("codes", lambda c: c - AUDIO_OFFSET)
    split = frames.deinterleave(coded.withColumn("codes", relative))
    return split.select("doc_id", *[ints(F.col(c)).alias(c) for c in ("l1", "l2", "l3")])


@query
def collapse_frames(spark, sf):
    collapsed = frames.collapse_frames(document_codes(spark, sf))
    return collapsed.select("doc_id", ints(F.col("codes")).alias("codes"), "removed")


def training_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return training.prepare_table(docs, with_codes, tokeniser(spark, sf))


@query
def train_sequence(spark, sf):
    docs = with_codes(table(spark, sf, "documents").select("doc_id", "text"))
    built = seq_op.train_sequence(tokeniser(spark, sf, "text")(docs))
    return built.select("doc_id", *[ints(F.col(c)).alias(c) for c in ("input_ids", "labels")])


@query
def ones_mask(spark, sf):
    docs = tokeniser(spark, sf, "text")(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", ints(seq_fn.ones(F.col("text_ids"))).alias("attention_mask"))


def prompt_rows(spark, sf):
    named = seq_op.voice_text(prompts(spark, sf))
    return seq_op.prompt_sequence(tokeniser(spark, sf)(named))


@query
def prompt_sequence(spark, sf):
    built = prompt_rows(spark, sf)
    return built.select("conv_id", "turn", ints(F.col("input_ids")).alias("input_ids"))


@query
def left_pad(spark, sf):
    matrix = batching.left_pad(prompt_rows(spark, sf), "conv_id")
    shown = [ints(F.col(c)).alias(c) for c in ("input_ids", "attention_mask")]
    return matrix.select("conv_id", "turn", *shown)


@query
def collate(spark, sf):
    """Training rows of the turns, padded per conversation."""
    turns = with_codes(prompts(spark, sf))
    built = seq_op.train_sequence(tokeniser(spark, sf, "text")(turns))
    padded = batching.collate(built, "conv_id")
    return padded.select("conv_id", "turn", *[ints(F.col(c)).alias(c) for c in TRAINING_COLUMNS])


@query
def first_channel(spark, sf):
    waves = waveforms(spark, sf)
    flipped = F.transform("samples", lambda v: -v)
    channels = waves.withColumn("channels", F.array("samples", flipped))
    first = audio_fn.first_channel(F.col("channels"))
    return channels.select("vec_id", micros(first).alias("samples"))


@query
def peak_normalise(spark, sf):
    waves = audio_op.peak_normalise(waveforms(spark, sf))
    return waves.select("vec_id", micros(F.col("samples")).alias("samples"))


@query
def silence(spark, sf):
    """A short silence for streams in which no codes are found."""
    found = extraction.extract_codes(streams(spark, sf)).withColumn(
        "samples", F.transform("codes", lambda c: (c / 1000).cast("float"))
    )
    sounded = audio_op.or_silence(found)
    return sounded.select("doc_id", micros(F.col("samples")).alias("samples"))


@query
def as_float(spark, sf):
    docs = table(spark, sf, "documents")
    lengths = F.transform(text_fn.words(F.col("text")), lambda w: F.length(w) / 3.0)
    return docs.select("doc_id", micros(audio_fn.as_float(lengths)).alias("samples"))


@query
def preview(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", text_fn.preview(F.col("text")).alias("preview"))


# --- token streams -----------------------------------------------------------------


@query
def crop_after_marker(spark, sf):
    cropped = extraction.crop_after_marker(streams(spark, sf))
    return cropped.select("doc_id", ints(F.col("ids")).alias("ids"))


@query
def crop_batchwise(spark, sf):
    cropped = extraction.crop_batchwise(streams(spark, sf), "source", "doc_id")
    return cropped.select("doc_id", ints(F.col("ids")).alias("ids"))


@query
def cut_at_stop(spark, sf):
    cut = extraction.cut_at_stop(streams(spark, sf))
    return cut.select("doc_id", ints(F.col("ids")).alias("ids"))


@query
def extract_codes(spark, sf):
    found = extraction.extract_codes(streams(spark, sf))
    return found.select("doc_id", ints(F.col("codes")).alias("codes"))


@query
def extract_codes_batchwise(spark, sf):
    found = extraction.extract_codes(streams(spark, sf), batch="source", row="doc_id")
    return found.select("doc_id", ints(F.col("codes")).alias("codes"))


@query
def whole_frames(spark, sf):
    ids = streams(spark, sf).withColumn("ids", codes_fn.whole_frames(F.col("ids")))
    return ids.select("doc_id", ints(F.col("ids")).alias("ids"))


@query
def classify_token(spark, sf):
    """Line items as token ids from all parts of the id space, counted by class."""
    audio = (F.col("l_orderkey") * 31 + F.col("l_partkey")) % (FRAME * CODEBOOK + 500)
    token = (
        F.when(F.col("l_linenumber") == 1, 128000 + F.col("l_suppkey") % 300)
        .when(F.col("l_linenumber") == 2, F.col("l_partkey"))
        .otherwise(AUDIO_OFFSET + audio)
        .cast("int")
    )
    items = table(spark, sf, "lineitem").select(token.alias("token"))
    return (
        extraction.classify_token(items)
        .groupBy("kind", "name", "slot", "layer")
        .agg(F.count("*").alias("n"), F.sum("code").alias("codes"))
    )


# --- hooks ---------------------------------------------------------------------


def count_lines(row: dict) -> dict:
    return {"lines": row["text"].count("\n") + 1}


def count_plain_lines(row: dict) -> dict:
    if "|" in row["text"]:
        raise ValueError("a table")
    return count_lines(row)


@query
def map_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return models.map_rows(docs, count_lines, "lines int").select("doc_id", "lines")


@query
def filter_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return models.filter_rows(docs, lambda text: "|" not in text, "text").select("doc_id")


@query
def safe_map(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    mapped = models.map_rows(docs, count_plain_lines, "lines int", ["text"])
    return mapped.select("doc_id", "lines", "error")


@query
def apply_tokenizer(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    coded = models.apply_tokenizer(docs, lambda: lambda text: [len(w) for w in text.split()])
    return coded.select("doc_id", ints(F.col("text_ids")).alias("text_ids"))


def quiet(spark, sf):
    waves = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("samples"))
    return models.apply_encoder(waves, quantiser)


@query
def apply_encoder(spark, sf):
    return quiet(spark, sf).select("vec_id", *[ints(F.col(c)).alias(c) for c in ("l1", "l2", "l3")])


@query
def encode_files(spark, sf):
    """WAV files coded where their rows are; documents without one are silence."""
    folder = wav_folder(spark, sf)
    items = table(spark, sf, "documents").select(
        "doc_id", text_fn.join_path(folder, F.format_string("vec_%d.wav", "doc_id")).alias("path")
    )
    coded = training.encode_files(quantiser)(items)
    return coded.select("doc_id", ints(F.col("codes")).alias("codes"))


@query
def encode_samples(spark, sf):
    waves = waveforms(spark, sf)
    made = tables.rows_to_table(
        waves, F.col("vec_id").cast("string"), F.col("samples"), F.lit(SAMPLE_RATE)
    )
    coded = training.encode_samples(quantiser)(made)
    return coded.select("text", ints(F.col("codes")).alias("codes"))


@query
def apply_decoder(spark, sf):
    decoded = models.apply_decoder(quiet(spark, sf), dequantiser)
    return decoded.select("vec_id", micros(F.col("samples")).alias("samples"))


def generate(df: DataFrame) -> DataFrame:
    inputs = ["input_ids", "max_new_tokens", "top_p"]
    return models.apply_generator(df, echo_batch, inputs, without_top_p, budget=20_000)


@query
def apply_generator(spark, sf):
    """Prompts under a preset each; two presets need the retry."""
    preset = F.when(F.col("turn") == 0, "stable").otherwise("expressive")
    asked = batching.resolve_params(prompt_rows(spark, sf).withColumn("preset", preset))
    return generate(asked).select("conv_id", "turn", ints(F.col("ids")).alias("ids"), "error")


# --- streaming -------------------------------------------------------------------


@query
def ingest_files(spark, sf):
    """Manifest files landed in a folder, taken in by a stream, read back."""
    target, marks = (new_table_path(spark, n) for n in ("taken", "marks"))
    landed = write_manifests(spark, sf)
    incremental_ingest(spark, landed, target, marks, files_per_trigger=16).awaitTermination()
    return shown_manifest(spark.read.parquet(target))


# --- flows ---------------------------------------------------------------------


def shown(df: DataFrame) -> DataFrame:
    return df.select(*[ints(F.col(c)).alias(c) for c in df.columns])


@query
def prepare_manifest(spark, sf):
    """Manifest lines to training rows: parse, match audio, code, collapse, build."""
    kept = manifest.kept(parsed(spark, sf))
    prepared = training.prepare_manifest(
        kept, inventory(spark, sf), with_codes, tokeniser(spark, sf), AUDIO_DIR
    )
    return shown(prepared.rows)


def faulty_codes(df: DataFrame) -> DataFrame:
    """Codes of a sentence; one with a bar cannot be coded, and a short one was unreadable and is silence."""
    barred = F.col("text").contains("|")
    coded = with_codes(df)
    return coded.withColumns(
        {
            "codes": F.when(~barred, F.col("codes")),
            "decode_ok": F.length("text") >= 40,
            "error": F.when(barred, "a table").when(F.length("text") < 40, "too short"),
        }
    )


def prepared_with_faults(spark: SparkSession, sf: str) -> training.Prepared:
    kept = manifest.kept(parsed(spark, sf))
    words_known = tokeniser(spark, sf)
    # A sentence in capitals has no ids.
    told = lambda df: words_known(df).withColumn(
        "text_ids", F.when(F.upper("text") != F.col("text"), F.col("text_ids"))
    )
    return training.prepare_manifest(kept, inventory(spark, sf), faulty_codes, told, AUDIO_DIR)


@query
def prepare_faults(spark, sf):
    """What went wrong while a manifest was prepared, row by row."""
    return prepared_with_faults(spark, sf).faults.select("path", "text", "step", "error", "trained")


@query
def prepare_counts(spark, sf):
    """How many rows passed each stage, counted while the manifest was prepared."""
    counts = prepared_with_faults(spark, sf).funnel
    return spark.createDataFrame(list(counts.items()), "stage string, n long")


@query
def prepare_table(spark, sf):
    """Documents with a speaker to training rows."""
    return shown(training_rows(spark, sf))


@query
def prompt_batches(spark, sf):
    """Conversations to padded prompt rows."""
    matrix = generation.prompt_batches(prompts(spark, sf), tokeniser(spark, sf), "conv_id")
    columns = [ints(F.col(c)).alias(c) for c in ("input_ids", "attention_mask")]
    return matrix.select("conv_id", "turn", *columns)


@query
def generated_audio(spark, sf):
    """Generated streams to normalised waveforms and file names."""
    decode = lambda df: models.apply_decoder(df, dequantiser)
    spoken = generation.generated_audio(streams(spark, sf), decode, normalise=True)
    named = generation.name_outputs(spoken, "out", "doc_id")
    return named.select("path", micros(F.col("samples")).alias("samples"))


@query
def slice_orders(spark, sf):
    """Slices of ``orders`` written out, and the plan of rounds over them."""
    orders = table(spark, sf, "orders")
    path = new_table_path(spark, "rounds")
    return slicing.slice_table(orders, path, ["o_orderkey"], 2000, 5000)


def spoken_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every line of every turn spoken; one line in seven, by its length, has no settings, and so fails."""
    limit = F.when(F.length("text") % 7 != 0, 1200)
    settings = {"max_new_tokens": limit, "top_p": F.lit(0.95)}
    return generation.line_batch(
        prompts(spark, sf).withColumn("key", F.format_string("%d_%d", "conv_id", "turn")),
        "key",
        "text",
        tokeniser(spark, sf),
        lambda df: generate(df.withColumns(settings)),
        lambda df: models.apply_decoder(df, dequantiser),
        new_table_path(spark, "lines"),
    )


@query
def line_batch(spark, sf):
    """Every line of every turn spoken into a file; the files that were written."""
    spoken, _ = spoken_lines(spark, sf)
    return table_sink.export_manifest(write_wavs(spoken.select("path", "samples")))


@query
def line_faults(spark, sf):
    """The lines that could not be spoken, with the step that failed."""
    _, faults = spoken_lines(spark, sf)
    return faults
