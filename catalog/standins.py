"""Speech-corpus inputs derived from the test tables.

Every derivation covers whole tables and whole texts and stays in the row's own
task: arrays come from the words of a text, never from collecting a group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechprep.constants import AUDIO_OFFSET, CODEBOOK, END_OF_SPEECH, FRAME
from speechprep.constants import START_OF_SPEECH
from speechprep.functions.text import words
from speechprep.operators.frames import interleave
from speechprep.operators.once import once
from speechprep.sources.tables import load_table

HEADER = "uuid,sentence"
AUDIO_DIR = "/audio"
# Places of one document before the next begins.
DOCUMENT = 2**31


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table as it lies, or dealt to ``catalog.partitions`` where that is set, as the bench does."""
    df = load_table(spark, f"{sf}/{name}.parquet")
    parts = spark.conf.get("catalog.partitions", None)
    return df.repartition(int(parts)) if parts else df


def ints(values: Column) -> Column:
    """Arrays as text, so that two engines can be compared."""
    return F.array_join(values.cast("array<string>"), ",")


def micro(value: Column) -> Column:
    """A sample as a whole number of millionths."""
    return F.floor(value.cast("double") * 1e6 + 0.5).cast("bigint")


def micros(samples: Column) -> Column:
    return ints(F.transform(samples, micro))


# --- codec layers: the words of a text, as three layers of sizes T, 2T, 4T ------


def with_layers(df: DataFrame, text: str = "text") -> DataFrame:
    word_code = lambda w: (F.ascii(w) * 31 + F.length(w) * 7) % CODEBOOK
    found = once(df, _w=words(F.col(text)))
    t = F.ceil(F.size("_w") / FRAME).cast("int")
    blanks = F.array_repeat(F.lit(""), FRAME * t - F.size("_w"))
    timed = once(found, _t=t, _w=F.concat("_w", blanks))
    t = F.col("_t")
    return once(
        timed,
        l1=F.transform(F.slice("_w", 1, t), lambda w: F.length(w) % 8),
        l2=F.transform(F.slice("_w", t + 1, 2 * t), word_code),
        l3=F.transform(F.slice("_w", 3 * t + 1, 4 * t), word_code),
    ).drop("_w", "_t")


def with_codes(df: DataFrame, text: str = "text") -> DataFrame:
    return interleave(with_layers(df, text)).drop("l1", "l2", "l3")


def document_codes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return with_codes(docs).drop("text")


# --- generated streams: one token per word -------------------------------------


def streams(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, source, ids)``; long words are markers, stops and noise."""
    n, code = F.length, lambda w: (F.ascii(w) * 31 + F.length(w) * 7) % CODEBOOK

    def token(w: Column, i: Column) -> Column:
        slot = (i + F.when(n(w) >= 12, 3).otherwise(0)) % FRAME
        return (
            F.when(w.startswith("|"), 1000 + n(w))
            .when(n(w) >= 17, START_OF_SPEECH)
            .when(n(w) == 16, END_OF_SPEECH)
            .otherwise(AUDIO_OFFSET + slot * CODEBOOK + code(w))
        )

    docs = table(spark, sf, "documents")
    found = once(docs.select("doc_id", "source", "text"), _w=words(F.col("text")))
    return once(found, ids=F.transform("_w", token)).select("doc_id", "source", "ids")


# --- manifests: one line per line of each document, one file per source ----------


def named_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, n, lang, source, name, sentence)``."""
    docs = table(spark, sf, "documents")
    lines = docs.select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("n", "sentence")
    )
    extension = (
        F.when(F.col("lang") == "de", ".mp3")
        .when(F.col("lang") == "es", ".WAV")
        .otherwise(".wav")
    )
    return lines.withColumn("name", F.format_string("doc_%d_%d%s", "doc_id", "n", extension))


def manifest_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``(file, pos, line)``, placed by document and line. Two-digit sources have a header; the first half of
    those quote their sentences. A one-word sentence is left out of its line, and a
    line of a table has no comma of its own."""
    s, name, source = F.col("sentence"), F.col("name"), F.col("source")
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    line = (
        F.when(~s.contains(" "), F.concat(name, F.lit(",")))
        .when(source.between("src10", "src14"), F.concat(name, F.lit(","), quoted))
        .when(s.contains("|"), F.concat(name, F.lit(" "), s))
        .otherwise(F.concat(name, F.lit(","), s))
    )
    data = named_lines(spark, sf).select(
        source.alias("file"),
        (F.col("doc_id") * DOCUMENT + F.col("n")).alias("pos"),
        line.alias("line"),
    )
    sources = load_table(spark, f"{sf}/documents.parquet").select("source").distinct()
    headers = sources.filter(F.length("source") == 5).select(
        source.alias("file"),
        F.lit(-1).cast("long").alias("pos"),
        F.lit(HEADER).alias("line"),
    )
    return data.union(headers)


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """``path`` of the audio of every line of a labelled document."""
    labels = table(spark, sf, "labels").select("doc_id")
    lines = named_lines(spark, sf).join(labels, "doc_id", "left_semi")
    return lines.select(F.concat(F.lit(AUDIO_DIR + "/"), "name").alias("path"))


# --- vocabulary, waveforms, prompts ----------------------------------------------


def vocab(spark: SparkSession, sf: str) -> DataFrame:
    """``(token, id)``: the words of ``benchmark``, numbered by 28 bits of their digest."""
    items = load_table(spark, f"{sf}/benchmark.parquet")
    found = items.select(F.explode(words(F.col("text"))).alias("token")).distinct()
    digits = F.substring(F.md5(F.encode("token", "utf-8")), 1, 7)
    return found.withColumn("id", F.conv(digits, 16, 10).cast("int"))


def waveforms(spark: SparkSession, sf: str) -> DataFrame:
    """``(vec_id, label, samples)``: embeddings, loud enough to pass 1."""
    louder = lambda x: (x.cast("double") * 10).cast("float")
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.transform("embedding", louder).alias("samples")
    )


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """``(conv_id, turn, voice, text)``; the system role has no voice."""
    turns = table(spark, sf, "conversations")
    voice = F.when(F.col("role") != "system", F.col("role"))
    return turns.select("conv_id", "turn", voice.alias("voice"), "text")


# --- injected models: small deterministic functions ------------------------------


def quantiser():
    """Encoder: samples in [-1, 1] to three layers, zero-padded to whole frames."""

    def encode(samples):
        x = np.asarray(samples, np.float64)
        t = -(-len(x) // FRAME)
        x = np.pad(x, (0, FRAME * t - len(x)))
        q = np.clip(np.floor((x + 1) * 2047.5), 0, CODEBOOK - 1).astype(int)
        return {"l1": q[:t], "l2": q[t : 3 * t], "l3": q[3 * t :]}

    return encode


def dequantiser():
    """Decoder: three layers back to samples, one after the other."""

    def decode(l1, l2, l3):
        return (np.concatenate([l1, l2, l3]) / 2047.5 - 1).astype(np.float32)

    return decode


def echo():
    """Generator: speaks the prompt's ids as frames; refuses a ``top_p`` below 0.9."""

    def generate(ids, limit, top_p):
        if top_p is not None and top_p < 0.9:
            raise ValueError("top_p")
        if not limit:
            raise ValueError("max_new_tokens")
        body = np.asarray(ids, np.int64)[:limit]
        slots = np.arange(len(body)) % FRAME
        audio = AUDIO_OFFSET + slots * CODEBOOK + body % CODEBOOK
        return [START_OF_SPEECH, *audio.tolist(), END_OF_SPEECH]

    return generate


def echo_batch():
    """The same for a list of rows; one bad row fails the call."""
    generate = echo()
    return lambda rows: [generate(*row) for row in rows]


def without_top_p(ids, limit, top_p):
    """The simpler settings of the retry."""
    return ids, limit, None
