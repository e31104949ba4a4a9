"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechprep.llm.common import placed_rows, positioned, whole_rows, word_count
from speechprep.session import settled

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = "mix"
#: Expected copies are fixed-point numbers with so many binary places, so that prefix sums are exact.
PLACES = 24


def source_targets(sources: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Add ``target`` to rows of (source_size, weight): shares by weight, none above ``most`` times its size.

    Sources whose share exceeds their cap stop there and the rest is shared anew by weight, until none is
    above. Only sums come to the driver, one pair of numbers for each round.
    """
    cap = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    full, unit = 0, 0.0
    while True:
        row = sources.agg(
            F.sum(F.when(cap > unit * F.col("weight"), F.col("weight"))).alias("weights"),
            F.sum(F.when(cap <= unit * F.col("weight"), cap)).alias("capped"),
            F.count(F.when(cap <= unit * F.col("weight"), 1)).alias("n"),
        ).first()
        if not row.weights or (unit and row.n == full):
            break
        full, unit = row.n, float(total - (row.capped or 0)) / float(row.weights)
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(unit) * F.col("weight")))


def offset(source: Column, seed: str = SEED) -> Column:
    """A source's one random offset, as a fixed-point fraction: 24 bits of a digest of seed and name."""
    name = F.coalesce(F.concat(F.lit("s:"), source), F.lit("null"))
    digits = F.substring(F.md5(F.encode(F.concat(F.lit(f"{seed}:"), name), "utf-8")), 1, PLACES // 4)
    return F.conv(digits, 16, 10).cast("long")


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
    carry: str | None = None,
) -> DataFrame:
    """One row per row of ``df``: doc_id, source, size, source_size, target, copies, taken, and ``at``, the column ``carry``.

    Sizes are words (null: 0). Sources in code point order, null last, weigh 1, 2, 3, 1, ...; see
    ``source_targets``. Each document of a source expects target / source_size copies. Along the documents
    of a source, in order of size and doc_id, the expected copies are summed up from the source's random
    offset, and a document is emitted once for each integer that the sum crosses. In order of size, what is
    taken misses the target by about one large document, not by chance. No document gets more copies than
    its expectation rounded up. Sources without words get nothing. Null and repeated ids are kept apart by a
    hash of the text; rows alike in all are interchangeable. Empty tables give an empty result.
    """
    rows = settled(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(text_col)).alias("text_hash"),
            *([] if carry is None else [F.col(carry).alias("at")]),
        ),
        "mix-sizes",
    )
    totals = settled(
        rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "mix-sources"
    )
    ranked = positioned(totals, ["source"], ["n_docs"], "mix-ranks")
    cycle = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("idx") % len(WEIGHTS) + 1).cast("int"))
    sources = settled(ranked.withColumn("weight", cycle), "mix-weights")
    sources = source_targets(sources).select(
        F.col("source").alias("source_"), "source_size", "target", F.col("before_n_docs").alias("first_"),
        F.when(
            F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * 2**PLACES).cast("long")
        ).otherwise(F.lit(0)).alias("rate"),
        offset(F.col("source"), seed).alias("offset"),
    )
    sources = settled(sources, "mix-targets")
    line = positioned(rows, ["source", "size", "doc_id", "text_hash"], [], "mix-line")
    before = (F.col("idx") - F.col("first_")) * F.col("rate") + F.col("offset")
    copies = F.shiftright(before + F.col("rate"), PLACES) - F.shiftright(before, PLACES)
    return (
        line.join(sources, line.source.eqNullSafe(sources.source_))
        .withColumn("copies", copies)
        .select(
            "doc_id", "source", "text_hash", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
            *([] if carry is None else ["at"]),
        )
    )


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``df`` as many times as it is drawn, with all its columns.

    Drawn on narrow rows; whole rows are shuffled once.
    """
    placed = placed_rows(df, "mix-input")
    names = {"doc_id": id_col, "text": text_col, "source": source_col}
    narrow = placed.select("at", *[F.col("row")[c].alias(name) for name, c in names.items()])
    drawn = mix_sources(narrow, carry="at").filter("copies > 0").select("at", "copies")
    chosen = whole_rows(placed, settled(drawn, "mix-drawn"), "inner")
    return chosen.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
