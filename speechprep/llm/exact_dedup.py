"""Exact duplicates by deterministic block naming.

Normalised texts are cut into blocks of a fixed size. Equal blocks get equal integer names by sorting them
inside hash buckets; then names of adjacent blocks are paired and the pairs named in the same way, until each
document has one name. Names are given by comparing whole blocks and whole pairs, so two documents share a
name (of the same level) only if their texts are equal: no hash stands for a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechprep.llm.common import SPACE, buckets, placed_rows, text_or_empty, whole_rows
from speechprep.session import settled

BLOCK_CHARS = 2048
#: The most frequent blocks are named apart, so that no bucket holds one of them many times.
FREQUENT = 400
NAME_BITS = 40


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null is empty. A lone space already is what it should be."""
    runs = f"{SPACE}{{2,}}|[\\x09-\\x0D]"
    return F.regexp_replace(text_or_empty(text), runs, " ")


def _blocks(text: Column, chars: int) -> Column:
    """Linear in the text: one scan of the pattern, where substrings would each start from the front."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def _named(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Add ``name``: the bucket and the rank of the key among the sorted keys of its bucket."""
    order = Window.partitionBy("bucket").orderBy(*keys)
    number = F.shiftleft((F.col("bucket") + 1).cast("long"), NAME_BITS) + F.dense_rank().over(order)
    return rows.withColumn("name", number)


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    carry: str | None = None,
) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256, and ``at``, the column ``carry``.

    * Texts are equal when identical after white space is normalised; null counts as empty.
    * keep_id is the smallest doc_id of the group. A null doc_id is larger than any other; keep_id is null
      only in a group that has no doc_id at all.
    * Repeated rows (same doc_id, same text) are members like any other; one of them is kept.
    * An empty table gives an empty result. Other columns are not read.

    Runs jobs when called: one for the frequent blocks, one or two for each doubling of the longest text.
    """
    spark = df.sparkSession
    n_buckets = buckets(spark)
    at = F.lit(None) if carry is None else F.col(carry)
    texts = df.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"), at.alias("at"))
    blocks = texts.select(F.explode(_blocks(F.col("norm"), block_chars)).alias("block"))
    hashed = blocks.withColumn("h", F.xxhash64("block"))
    top = hashed.groupBy("h").count().orderBy(F.desc("count"), "h").limit(FREQUENT)
    frequent = [row.h for row in top.collect() if row["count"] > 1]
    # At most FREQUENT hashes, each of one block (or, in theory, of a few that collide).
    common = (
        hashed.filter(F.col("h").isin(frequent) if frequent else F.lit(False))
        .distinct()
        .withColumn("common_name", F.row_number().over(Window.orderBy("h", "block")).cast("long"))
    )
    common = settled(common, "frequent-blocks")

    placed = (
        texts.withColumn("uid", F.monotonically_increasing_id())
        .withColumn("text_sha256", F.sha2(F.encode("norm", "utf-8"), 256))
        .withColumn("blocks", _blocks(F.col("norm"), block_chars))
        .select("uid", "doc_id", "text_sha256", "at", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
        .withColumns({c: F.when(F.col("pos") == 0, F.col(c)) for c in ("text_sha256", "at")})
        .withColumn("h", F.xxhash64("block"))
        .join(F.broadcast(common), ["h", "block"], "left")
    )
    known = F.col("common_name").isNotNull()
    dealt = placed.select(
        "uid", "doc_id", "text_sha256", "at", "n", "pos", "common_name",
        F.when(~known, F.col("block")).alias("block"),
        F.pmod(F.when(known, F.xxhash64("uid", "pos")).otherwise(F.col("h")), F.lit(n_buckets)).alias("bucket"),
    )
    level = settled(
        _named(dealt, ["block"], n_buckets)
        .withColumn("name", F.coalesce("common_name", "name"))
        .drop("block", "bucket", "common_name", *(["at"] if carry is None else [])),
        "block-names",
    )
    rows = level.filter("pos = 0").select("uid", "doc_id", "text_sha256", *([] if carry is None else ["at"]))
    longest = level.agg(F.max("n")).first()[0] or 0

    finished = [level.filter("n = 1").select("uid", F.lit(0).alias("level"), "name")]
    level = level.filter("n > 1").select("uid", "n", "pos", "name")
    step = 0
    while longest > 1:
        step, longest = step + 1, (longest + 1) // 2
        level = _next_level(level, n_buckets)
        finished.append(level.filter("n = 1").select("uid", F.lit(step).alias("level"), "name"))
        level = level.filter("n > 1")
    identity = finished[0]
    for more in finished[1:]:
        identity = identity.unionByName(more)

    members = settled(rows.join(identity, "uid"), "text-names")
    order = F.coalesce("doc_id", F.lit(2**63 - 1))
    groups = settled(
        members.groupBy("level", "name")
        .agg(
            F.min("doc_id").alias("keep_id"),
            F.count("*").alias("group_size"),
            F.min_by("uid", order).alias("keep_uid"),
        )
        .filter("group_size > 1"),
        "text-groups",
    )
    return members.join(groups, ["level", "name"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True)).alias("kept"),
        "text_sha256",
        *([] if carry is None else ["at"]),
    )


def _next_level(level: DataFrame, n_buckets: int) -> DataFrame:
    """Pair the names at positions 2k and 2k+1, name the distinct pairs, and put the names in their place."""
    even = F.col("pos") % 2 == 0
    pairs = (
        level.groupBy("uid", F.expr("cast(pos div 2 as int)").alias("half"))
        .agg(
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
            F.max("n").alias("n"),
        )
        .withColumn("n", F.expr("cast((n + 1) div 2 as int)"))
    )
    pairs = settled(pairs, "name-pairs")
    distinct = pairs.select("left", "right").distinct()
    dealt = distinct.withColumn("bucket", F.pmod(F.xxhash64("left", "right"), F.lit(n_buckets)))
    names = settled(_named(dealt, ["left", "right"], n_buckets).drop("bucket"), "pair-names")
    # A frequent pair is one row of names; the adaptive skew join splits the rows that look it up.
    return settled(
        pairs.join(names, ["left", "right"]).select("uid", "n", F.col("half").alias("pos"), "name"), "next-names"
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose copy is the one that stays, with all their columns.

    Copies that share even their doc_id are told apart by nothing: one of them stays, whichever. Decided on narrow
    rows; whole rows are shuffled once.
    """
    placed = placed_rows(df, "exact-input")
    narrow = placed.select("at", F.col("row")[id_col].alias("doc_id"), F.col("row")[text_col].alias("text"))
    found = exact_dedup(narrow, carry="at")
    stays = settled(found.filter("kept").select("at"), "exact-kept")
    return whole_rows(placed, stays).select("row.*")
