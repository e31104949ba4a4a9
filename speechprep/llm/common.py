"""What the operators share: reading, text rules, global positions, worker caches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechprep.session import settled

#: White space as the contracts define it, for Java and Python patterns alike.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def buckets(spark: SparkSession) -> int:
    """How many buckets to deal names to: several for each shuffle partition, so that these fill evenly."""
    return 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def positioned(df: DataFrame, order: list[str], measures: list[str], name: str) -> DataFrame:
    """Add each row's global position and running sums in an order, without one global window.

    Rows are dealt by range on ``order`` and written to the shared folder in that order. One row per
    written partition carries its count and sums; their prefix sums (as many rows as partitions) are
    added to the running counts and sums inside each partition. ``order`` must tell all rows apart that
    are not alike in every column. Adds ``idx`` (from 0), ``before_<measure>`` (sum over earlier rows) and
    ``total_<measure>`` (over all).
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(k).asc_nulls_last() for k in order]
    written = settled(
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumns({"part_": F.spark_partition_id(), "seq_": F.monotonically_increasing_id()}),
        name,
    )
    sums = [F.sum(m).alias(f"sum_{m}") for m in measures]
    totals = written.groupBy("part_").agg(F.count("*").alias("rows_"), *sums)
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part_",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"off_{c}") for c in totals.columns[1:]],
        *[F.sum(f"sum_{m}").over(everything).alias(f"total_{m}") for m in measures],
    )
    within = Window.partitionBy("part_").orderBy("seq_").rowsBetween(Window.unboundedPreceding, -1)
    here = {"in_rows_": F.count("*").over(within)} | {
        f"in_{m}": F.coalesce(F.sum(m).over(within), F.lit(0)) for m in measures
    }
    # At most as many rows as there are partitions.
    joined = written.withColumns(here).join(F.broadcast(offsets), "part_")
    return joined.select(
        *df.columns,
        (F.col("off_rows_") + F.col("in_rows_")).alias("idx"),
        *[(F.col(f"off_sum_{m}") + F.col(f"in_{m}")).alias(f"before_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )


def placed_rows(df: DataFrame, name: str = "placed") -> DataFrame:
    """(row, at): each row whole in one struct, so that no name can clash, and where it lies (file and place).

    Places are those of Parquet files and stay the same whatever runs again; a table that does not lie in Parquet
    files is written first.
    """
    try:
        meta = df.metadataColumn("_metadata")
        at = F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("place"))
        return df.select(F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns]).alias("row"), at.alias("at"))
    except AnalysisException:
        return placed_rows(settled(df, name), name)


def whole_rows(placed: DataFrame, chosen: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``placed_rows`` whose ``at`` is in the written table ``chosen``, which gives its other columns too.

    The one shuffle of whole rows that a stage needs: they meet the narrow table by place, in hash maps of its
    partitions. It is the same plan at every size, since the narrow table grows with the rows.
    """
    return placed.join(chosen.hint("shuffle_hash"), "at", how)


def chosen_by_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each value of ``key``: those with the smallest ``h``, a 64-bit hash.

    ``key`` must have few values, since their counts are broadcast. Values are counted first, and rows whose hash is too large to come among the first are left out before
    rows of a value meet in one task: about three times ``most`` meet there, whatever the table.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n_"))
    span = F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(3.0 * most + 100) / F.col("n_"))
    near = rows.join(F.broadcast(counts), key).filter(F.col("h").cast("double") + 2.0**63 <= span)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("h"))
    return near.withColumn("r_", rank).filter(F.col("r_") <= most).drop("r_", "n_")


def collected_features(rows: DataFrame) -> list[tuple]:
    """A bounded sample (h, label, used, value) on the driver, in order of h and label: (used, value, label) each.

    ``used`` are whole numbers and ``value`` floats of 32 bits; what brought them here is let go.
    """
    out = []
    for batch in rows.toArrow().to_batches():
        for h, label, used, value in zip(*(batch.column(c) for c in ("h", "label", "used", "value"))):
            out.append((h.as_py(), label.as_py(), used.values.to_numpy().copy(), value.values.to_numpy().copy()))
    pa.default_memory_pool().release_unused()
    out.sort(key=lambda row: row[:2])
    return [(used, value, label) for _, label, used, value in out]


def worker_store(name: str) -> dict:
    """A dict that lives as long as this Python worker, whatever tasks come and go.

    Task functions travel by value and would start with empty globals each time.
    """
    holder = sys.modules.setdefault("speechprep_worker_store", types.ModuleType("speechprep_worker_store"))
    return holder.__dict__.setdefault(name, {})


class Shared:
    """A broadcast, and what a worker makes of it once for all its tasks."""

    def __init__(self, spark: SparkSession, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = str(self.broadcast._jbroadcast.id()) + spark.sparkContext.applicationId

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    def made(self, kind: str, make: Callable):
        """``make(value)``, remembered; of one kind a worker holds the last only."""
        store = worker_store(kind)
        if self.id not in store:
            store.clear()
            store[self.id] = make(self.broadcast.value)
        return store[self.id]
