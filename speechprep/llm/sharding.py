"""Contiguous shards of nearly equal bytes, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechprep.llm.common import positioned, text_or_empty


def shard_by_bytes(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows are laid out by doc_id (null last; ties by checksum, size and a hash of the text). Each has the
    UTF-8 bytes of its text plus one; sums over earlier rows come from the totals of range partitions. The
    line of bytes is cut at equal targets, and a row belongs to the shard that holds its middle byte, so a
    shard is off its target by no more than half of one text at each end. A text longer than a target fills
    its shard alone; shards may then be empty. Slots count from 0 inside a shard. ``grown_shard`` is null:
    under this law one more shard moves all cuts. Null texts have no bytes, and checksum 0 as empty ones.
    Repeated rows each take their place. An empty table gives an empty result; other columns are not read.
    """
    text = text_or_empty(text_col)
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.xxhash64(text).alias("tie_"),
    )
    line = positioned(rows, ["doc_id", "text_crc32", "size", "tie_"], ["size"], "shard-line")
    # Whole numbers, since a rounded quotient could pass a cut on very large totals.
    middle = (2 * F.col("before_size") + F.col("size")).cast("decimal(27,0)") * F.lit(shards).cast("decimal(10,0)")
    cut = F.call_function("div", middle, (2 * F.col("total_size")).cast("decimal(27,0)"))
    placed = line.withColumn("shard", F.least(cut, F.lit(shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("idx").alias("first_"))
    return placed.join(F.broadcast(first), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("idx") - F.col("first_")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
