"""Vocabulary: look-up, coverage, token counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..constants import AUDIT_TEXTS, COMMON_TOKENS, START_OF_TEXT
from ..functions.text import coverage_flag, words
from ..session import settled
from .models import pieces
from .once import once
from .rows import cap_rows

# A vocabulary of at most this many entries is sent to every executor.
MAX_BROADCAST_TOKENS = 1_000_000
# Rows of a slice with a dictionary of its own, and letters of their texts.
SLICE_ROWS, SLICE_CHARS = 1_024, 2_000_000


def tokens_of(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``(keep.., pos, token)``: the words of each text."""
    return df.select(*keep, F.posexplode(words(F.col(text))).alias("pos", "token"))


def vocab_lookup(tokens: DataFrame, vocab: DataFrame, unk: int) -> DataFrame:
    """Add ``id`` of each token; Spark broadcasts the vocabulary when it is small."""
    return tokens.join(vocab.select("token", "id"), "token", "left").withColumn(
        "id", F.coalesce("id", F.lit(unk))
    )


def tokenise(
    df: DataFrame,
    vocab: DataFrame,
    text: str = "text",
    out: str = "text_ids",
    unk: int = 0,
    special: bool = True,
    max_broadcast: int = MAX_BROADCAST_TOKENS,
) -> DataFrame:
    """Add word ids of each text, led by start-of-text when ``special``.

    A token listed more than once has its smallest id. A vocabulary within the bound goes to every executor
    and rows stay where they are; a larger one is joined with the distinct tokens of slices of the rows. Both give the
    same.
    """
    vocab = vocab.groupBy("token").agg(F.min("id").alias("id"))
    entries = vocab.limit(max_broadcast + 1).collect()
    lead = F.array(*([F.lit(START_OF_TEXT)] if special else [])).cast("array<int>")
    if len(entries) <= max_broadcast:
        encode = _word_encoder(df, {e["token"]: e["id"] for e in entries}, unk)
        coded = df.withColumn("_ids", encode(text))
    else:
        coded = _ids_by_slices(df, vocab, text, unk)
    return once(coded, **{out: F.concat(lead, "_ids")}).drop("_ids")


def _ids(texts: pa.Array, get: Callable, unk: int) -> pa.Array:
    ids = [None if t is None else [get(w, unk) for w in t.split()] for t in texts.to_pylist()]
    return pa.array(ids, pa.list_(pa.int32()))


def _word_encoder(df: DataFrame, ids: dict[str, int], unk: int):
    shared = df.sparkSession.sparkContext.broadcast(ids)

    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        get = shared.value.get
        for batch in texts:
            for (some,) in pieces((batch,)):
                yield _ids(some, get, unk)

    return encode


def _ids_by_slices(df: DataFrame, vocab: DataFrame, text: str, unk: int) -> DataFrame:
    """Add ``_ids`` by a dictionary for each slice of the rows.

    A task packs its rows into slices and names the distinct tokens of each; the slices are written once. Distinct
    (slice, token) pairs are joined with the vocabulary and come back as one dictionary a slice. Whole slices meet
    their dictionaries, so no occurrence of a token is ever a row, however frequent it is.
    """
    row = T.StructType(df.schema.fields)
    packed = T.StructType(
        [T.StructField("rows", T.ArrayType(row)), T.StructField("tokens", T.ArrayType(T.StringType()))]
    )
    kind = to_arrow_type(T.ArrayType(row))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text)
            start, held, tokens = 0, 0, set()
            for at, value in enumerate(texts, 1):
                words = (value.as_py() or "").split()
                tokens.update(words)
                held += 1 + sum(map(len, words))
                if held >= SLICE_CHARS or at - start >= SLICE_ROWS or at == batch.num_rows:
                    whole = batch.slice(start, at - start).to_struct_array()
                    rows = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole).cast(kind)
                    yield pa.RecordBatch.from_arrays(
                        [rows, pa.array([list(tokens)], pa.list_(pa.string()))], ["rows", "tokens"]
                    )
                    start, held, tokens = at, 0, set()

    slices = settled(df.mapInArrow(pack, packed).withColumn("slice", F.monotonically_increasing_id()), "slices")
    asked = slices.select("slice", F.explode("tokens").alias("token"))
    entries = F.collect_list(F.struct("token", "id")).alias("entries")
    told = settled(asked.join(vocab, "token").groupBy("slice").agg(entries), "slice-dictionaries")
    coded = T.StructType([*row, T.StructField("_ids", T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, entries in zip(batch.column("rows"), batch.column("entries")):
                get = {e["token"]: e["id"] for e in entries.as_py() or ()}.get
                own = rows.values
                columns = [own.field(k) for k in range(len(row))]
                yield pa.RecordBatch.from_arrays([*columns, _ids(own.field(text), get, unk)], coded.names)

    return slices.select("slice", "rows").join(told, "slice", "left").mapInArrow(encode, coded)


def token_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def top_tokens(
    tokens: DataFrame, order: str, k: int = COMMON_TOKENS, pos: str = "pos"
) -> DataFrame:
    """The ``k`` commonest tokens; a tie goes to the token met first.

    ``order`` is the text's number. Text and place make one decimal, which a hash
    aggregate can hold; the minimum of a struct would sort all tokens.
    """
    place = F.col(order).cast("decimal(20,0)") * F.lit(2**32).cast("decimal(12,0)")
    counted = tokens.groupBy("token").agg(
        F.count("*").alias("n"), F.min(place + F.col(pos)).alias("_met")
    )
    return counted.orderBy(F.desc("n"), "_met").limit(k).select("token", "n")


def audit_sample(df: DataFrame, *order: str, n: int | None = AUDIT_TEXTS) -> DataFrame:
    """The first texts, which the vocabulary audit looks at; ``None`` for all."""
    return cap_rows(df, n, *order)


def vocab_coverage(df: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """One row: texts, tokens, unknown tokens, coverage rate and flag, mean length.

    Tokens are counted before the join, so the join sees each distinct token once
    and a token that fills a third of the corpus is one row.
    """
    placed = df.select(F.posexplode_outer(words(F.col(text))).alias("pos", "token"))
    first = F.col("pos").isNull() | (F.col("pos") == 0)
    counts = placed.groupBy("token").agg(
        F.count("token").alias("tokens"), F.count_if(first).alias("texts")
    )
    known = vocab.select("token", F.lit(True).alias("_known")).distinct()
    unknown = F.when(F.col("_known").isNull(), F.col("tokens")).otherwise(0)
    counted = counts.join(known, "token", "left").withColumn("unk", unknown)
    zero = F.lit(0)
    rate = F.when(
        F.col("total_tokens") > 0,
        (F.col("total_tokens") - F.col("unk_tokens")) / F.col("total_tokens") * 100,
    ).otherwise(F.lit(0.0))
    mean = F.when(
        F.col("total_texts_analyzed") > 0,
        F.col("total_tokens") / F.col("total_texts_analyzed"),
    ).otherwise(F.lit(0.0))
    return (
        counted.agg(
            F.coalesce(F.sum("texts"), zero).alias("total_texts_analyzed"),
            F.coalesce(F.sum("tokens"), zero).alias("total_tokens"),
            F.coalesce(F.sum("unk"), zero).alias("unk_tokens"),
        )
        .withColumns({"coverage_rate": rate, "avg_tokens_per_text": mean})
        .withColumn("coverage_flag", coverage_flag(F.col("coverage_rate")))
    )
