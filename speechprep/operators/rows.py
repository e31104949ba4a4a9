"""Row-level operators: keep-lists, valid rows, dense order, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TRAINING_COLUMNS
from ..session import settled

# Keys that a round of the search for a cut compares with, and rows that are put in order to find it.
PIVOTS, ORDERED = 64, 10_000


def has_codes(df: DataFrame, codes: str = "codes") -> DataFrame:
    """Rows whose codes are neither null nor empty."""
    return df.filter(F.col(codes).isNotNull() & (F.size(codes) > 0))


def keep_columns(df: DataFrame, keep: list[str] = TRAINING_COLUMNS) -> DataFrame:
    """The columns on the list, in table order; absent names are ignored."""
    return df.select(*[c for c in df.columns if c in keep])


def row_index(df: DataFrame, *order: str | Column, name: str = "idx") -> DataFrame:
    """Add a dense 0-based position in the given total order.

    The rows are sorted over all tasks into a table in the shared folder, each with the
    task that wrote it and its place there. A row's position is that place plus the rows
    of the tasks before, so no task ever sees more than its own range, and a lost
    executor changes nothing.
    """
    placed = settled(
        df.orderBy(*order).withColumns(
            {"_task": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}
        ),
        "ordered",
    )
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_task")
        .count()
        .select("_task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_at"))
    )
    # The lower 33 bits of the generated id count inside the task.
    place = F.col("_place").bitwiseAND(F.lit(2**33 - 1))
    # One row per task that wrote.
    return placed.join(F.broadcast(offsets), "_task").select(
        *df.columns, (F.col("_at") + place).alias(name)
    )


def cap_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` rows in the order of these columns, nulls first; ``None`` keeps all, ``0`` none.

    Finds the key of the n-th row and keeps the rows up to it, where they are: nothing is sorted or written. Jobs
    that find it run when this is called; they read the order columns only.
    """
    if n is None:
        return df
    if n <= 0:
        return df.filter(F.lit(False))
    cut, more = _cut_at(df.select(*order), n)
    if cut is None:
        return df
    key = F.struct(*order)
    first = F.col(order[0])
    # The leading column alone is a filter that a scan can use.
    near = df if cut[0] is None else df.filter(first.isNull() | (first <= _literal(df, order[0], cut[0])))
    cut = F.struct(*[_literal(df, c, v).alias(c) for c, v in zip(order, cut)])
    if more is None:
        return near.filter(key <= cut)
    # Several rows have the key of the cut, and not all are within the cap.
    return near.filter(key < cut).unionByName(near.filter(key == cut).limit(more))


def _literal(df: DataFrame, name: str, value) -> Column:
    return F.lit(value).cast(df.schema[name].dataType)


def _cut_at(keys: DataFrame, n: int) -> tuple[tuple | None, int | None]:
    """The key of the n-th row, and how many rows of that key are within the first n (``None``: all).

    ``(None, None)`` with no more than n rows. The rows that may hold the cut are counted between PIVOTS of their
    keys, drawn by a hash; the stretch in which the n-th lies becomes the next round's, until it is small enough
    to be put in order or has one key only. Some PIVOTS keys and counts come to the driver a round.
    """
    order = keys.columns
    whole = keys.select(F.struct(*order).alias("k"))
    lit = lambda key: F.struct(*[_literal(keys, c, v).alias(c) for c, v in zip(order, key)])
    here, before, found = whole, 0, None
    while True:
        drawn = here.withColumn("_draw", F.rand(7)).orderBy("_draw").limit(PIVOTS).select("k").distinct()
        pivots = [tuple(r.k) for r in drawn.orderBy("k").collect()]
        if not pivots:
            return None, None
        above = sum((F.col("k") > lit(p)).cast("int") for p in pivots)
        counts = dict(here.groupBy(above.alias("at")).count().collect())
        if found is None and sum(counts.values()) <= n:
            return None, None
        at = 0
        while before + counts.get(at, 0) < n:
            before += counts.get(at, 0)
            at += 1
        low, high = pivots[at - 1] if at else None, pivots[at] if at < len(pivots) else None
        if low is not None:
            here = here.filter(F.col("k") > lit(low))
        if high is not None:
            here = here.filter(F.col("k") <= lit(high))
        found = counts[at]
        ends = here.agg(F.min("k").alias("a"), F.max("k").alias("b")).first() if found > ORDERED else None
        if ends and ends.a == ends.b:
            return tuple(ends.a), None if before + found == n else n - before
        if found <= ORDERED:
            ordered = [tuple(r.k) for r in here.orderBy("k").limit(n - before + 1).collect()]
            cut = ordered[n - before - 1]
            same = ordered.count(cut)
            if len(ordered) > n - before and ordered[-1] == cut:
                return cut, same - 1
            return cut, None


def reason_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


def existing_audio(df: DataFrame, inventory: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file is in the inventory."""
    return df.join(inventory.select(path), path, "left_semi")


def missing_audio(df: DataFrame, inventory: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file is not."""
    return df.join(inventory.select(path), path, "left_anti")
