"""Near copies among embeddings, by counting collisions of one-dimensional projections.

Unit vectors at cosine c are sqrt(2 - 2 c) apart, and a random projection tells them apart by a normal number of that
spread. Vectors of a label are sorted by a projection; the vectors in a wide window around a vector are its partners,
and their collisions with it (windows around its value) are counted over many more projections. Pairs with enough
collisions are verified by their cosine. Windows and the count are calibrated by the binomial formula, so that a
pair just at the threshold passes with the asked probability.

A pair must also meet in one of several tables of leading projections, cut into cells with random offsets. Their number
is fixed, and so large that about no pair fails. Vectors of a large label are dealt by these cells, and a pair is counted
in the first one it meets in; a smaller label is one cell, where the tables are only looked up. So whether a pair is found
depends on its two vectors alone, however many others there are. A crowded cell is compared block against block, so that
no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, comb, erf, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechprep.llm.components import components
from speechprep.llm.simhash import _join
from speechprep.session import settled

LEAST, RECALL, SEED = 0.98, 0.98, 11
#: Projections that are counted, and half their window in spreads of a pair at the threshold; half the window of the
#: one that vectors are sorted by.
COUNTED, WINDOW, WIDE = 16, 2.5, 5.0
#: Projections that are counted for all partners; the others for those that can still pass.
ALWAYS = 6
#: Width of a table's cells, in spreads of all unit vectors; vectors that a label may hold before it is dealt by tables;
#: vectors of a block.
CELL, ROOMY, BLOCK = 2.0, 32_768, 2048
#: Leading projections of a table, at all sizes; the share of what ``recall`` leaves that the tables may lose; tables
#: that vectors of large labels are dealt by at once.
LEADS, LOST, DEALT = 10, 1e-4, 6
#: Vectors whose partners are looked up at once, and pairs verified at once.
TILE, VERIFIED = 64, 16_384


def _inside(half: float) -> float:
    """Probability that a normal number lies within so many spreads."""
    return erf(half / sqrt(2))


def least_count(counted: int = COUNTED, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count of collisions that a pair at the threshold reaches with a probability of ``recall`` and half
    of what that leaves for the tables."""
    p = _inside(window)
    passed = 0.0
    for count in range(counted, 0, -1):
        passed += comb(counted, count) * p**count * (1 - p) ** (counted - count)
        if passed * _inside(WIDE) >= 1 - (1 - recall) / 100:
            return count
    return 0


def tables_for(vectors: int, apart: float, recall: float = RECALL, roomy: int = ROOMY) -> tuple[int, int]:
    """(leading projections of a table, tables) that make cells of ``vectors`` roomy; (0, 1) if one cell will do."""
    if vectors <= roomy:
        return 0, 1
    leads = ceil(log(vectors / roomy) / log(2))  # a cut at least halves a cell on average
    # The formula is an average over pairs; those of one cluster share its luck, and a cut through its middle parts half.
    together = min(0.5, (1 - apart * sqrt(2 / np.pi) / CELL) ** leads)
    return leads, ceil(log((1 - recall) / 2) / log(1 - together))


def all_tables(apart: float, recall: float = RECALL) -> tuple[int, int]:
    """(leading projections of a table, tables) of all labels, whatever their size."""
    return tables_for(ROOMY << LEADS, apart, 1 - LOST * (1 - recall))


def directions(size: int, count: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, count))


def unit_vectors(batch: pa.ListArray, size: int) -> np.ndarray:
    """Rows of length 1, in double precision; what is scaled first cannot overflow."""
    x = batch.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size) if len(batch) else np.zeros((0, size))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _lists(column: pa.Array | pa.ChunkedArray) -> pa.ListArray:
    """One list array whose values are its own."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]), pa.int32()), column.flatten())


def cells(x: np.ndarray, leads: int, tables: int) -> np.ndarray:
    """One number a vector and table: a hash of the cells of the table's leading projections (0 without any)."""
    if not leads:
        return np.zeros((len(x), tables), np.int64)
    offsets = np.random.default_rng([SEED, 1]).random(leads * tables) * CELL
    # The first COUNTED + 1 directions are used for the count.
    at = np.floor((x @ directions(x.shape[1], COUNTED + 1 + leads * tables)[:, COUNTED + 1 :] + offsets) / CELL)
    key = np.zeros((len(x), tables), np.uint64)
    for part in at.astype(np.int64).view(np.uint64).reshape(len(x), tables, leads).transpose(2, 0, 1):
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def meet(x: np.ndarray, y: np.ndarray | None, apart: float, least: float, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of x, rows of y) at a cosine of at least ``least`` that enough projections find; within x without y."""
    within = y is None
    if within:
        y = x
    chosen = directions(x.shape[1], COUNTED + 1)[:, : COUNTED + 1]
    p, q = x @ chosen, y @ chosen
    order, partners = np.argsort(p[:, 0], kind="stable"), np.argsort(q[:, 0], kind="stable")
    p, q = p[order].astype(np.float32), q[partners].astype(np.float32)
    window, wide, missed = np.float32(WINDOW * apart), WIDE * apart, COUNTED - count
    columns = np.ascontiguousarray(q.T)
    for at in range(0, len(p), TILE):
        own = p[at : at + TILE]
        low = at if within else np.searchsorted(columns[0], own[0, 0] - wide)
        high = np.searchsorted(columns[0], own[-1, 0] + wide, "right")
        if high <= low:
            continue
        misses = np.zeros((len(own), high - low), np.uint8)
        for k in range(1, 1 + ALWAYS):
            misses += np.abs(own[:, k, None] - columns[k, low:high]) > window
        a, b = np.nonzero(misses <= missed)
        still = misses[a, b]
        b += low
        for k in range(1 + ALWAYS, 1 + COUNTED):
            still = still + (np.abs(own[a, k] - columns[k, b]) > window)
            left = still <= missed
            a, b, still = a[left], b[left], still[left]
        a += at
        # What else the tile's window holds would depend on the neighbours of a.
        own_window = np.abs(p[a, 0] - columns[0, b]) <= wide
        if within:
            own_window &= a < b
        a, b = a[own_window], b[own_window]
        a, b = order[a], partners[b]
        for some in range(0, len(a), VERIFIED):
            i, j = a[some : some + VERIFIED], b[some : some + VERIFIED]
            near = np.einsum("ij,ij->i", x[i], y[j]) >= least
            yield i[near], j[near]


def _group(least: float, apart: float, count: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        table, _, size, _, low, high = (k.as_py() for k in key)
        vectors = unit_vectors(_lists(group.column("vector")), size)
        node, block, copies = (group.column(n).to_numpy() for n in ("node", "block", "copies"))
        cell = np.stack(group.column("cells").to_numpy())[:, : None if table < 0 else table]
        left = np.flatnonzero(block == low)
        right = None if low == high else np.flatnonzero(block == high)
        links = np.zeros(len(node), np.int64)
        label = np.arange(len(node))
        # Rows in order of node, so that the smallest place of a tree is its smallest node.
        place = np.empty(len(node), np.int64)
        place[np.argsort(node)] = np.arange(len(node))
        for a, b in meet(vectors[left], None if right is None else vectors[right], apart, least, count):
            a, b = left[a], (left if right is None else right)[b]
            met = (cell[a] == cell[b]).any(axis=1)
            new = met if table < 0 else ~met  # in any table, or in none before this
            a, b = a[new], b[new]
            links += np.bincount(a, copies[b], len(node)).astype(np.int64) + np.bincount(b, copies[a], len(node)).astype(np.int64)
            label = _join(label, place[a], place[b])
        linked = np.flatnonzero(links)
        root = np.sort(node)[label[place[linked]]]
        return pa.table({"node": node[linked], "root": root, "links": links[linked]})

    return run


def vector_nodes(df: DataFrame, vector_col: str, label_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, label, vector; both null where nothing can be linked), and their distinct vectors, numbered."""
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    fine &= F.exists(vector, lambda v: v != 0) & F.col(label_col).isNotNull()
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.when(fine, F.col(label_col)).alias("label"),
        F.when(fine, vector).alias("vector"),
    )
    nodes = rows.filter("vector is not null").groupBy("label", "vector").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies")
    )
    return rows, settled(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = LEAST,
    recall: float = RECALL,
    roomy: int = ROOMY,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Vectors of equal, not null labels (and equal lengths) are linked at a cosine of at least ``least``, in double
    precision; pairs are found with a probability of at least ``recall``, and every link that is found is exact. Whether
    a pair is found does not depend on the other rows; ``roomy`` and ``block`` only part the work.
    n_links counts the other rows linked directly; component_id is the smallest vec_id that links lead to, its own if
    there are none; kept is whether that is the row's own. Vectors that are null, empty, zero, or hold null, NaN or
    infinite components link with nothing. Equal vectors are worked on once and linked with each other. A null vec_id
    is never smallest; component_id is null only where no row has an id. An empty table gives an empty result.
    Other columns are not read. Jobs run when this is called.
    """
    apart = sqrt(2 - 2 * least)
    rows, nodes = vector_nodes(df, vector_col, label_col, id_col)
    space = nodes.select("node", "label", "copies", F.size("vector").alias("size"), "vector")
    leads, tables = all_tables(apart, recall)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                some = batch.filter(pa.array(sizes == size))
                found = cells(unit_vectors(_lists(some.column("vector")), int(size)), leads, tables) >> 32
                ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * tables)
                listed = pa.ListArray.from_arrays(ends, pa.array(found.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([*some.columns, listed], [*some.schema.names, "cells"])

    kind = nodes.schema["label"].dataType.simpleString()
    coded = settled(
        space.mapInArrow(code, f"node long, label {kind}, copies long, size int, vector array<double>, cells array<int>"),
        "vector-cells",
    )
    large = settled(space.groupBy("label", "size").count().filter(F.col("count") > roomy).drop("count"), "vector-labels")
    one = coded.join(large, ["label", "size"], "left_anti").withColumns({"t": F.lit(-1), "cell": F.lit(0)})
    parts = [one]
    if not large.isEmpty():
        apart_by = coded.join(large, ["label", "size"], "left_semi")
        for first in range(0, tables, DEALT):
            some = apart_by.select("*", F.posexplode(F.slice("cells", first + 1, DEALT)).alias("t", "cell"))
            parts.append(some.withColumn("t", F.col("t") + first))
    keys = ["t", "label", "size", "cell"]

    def linked(dealt: DataFrame) -> DataFrame:
        met = settled(dealt.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"), "vector-groups")
        blocks = F.ceil(F.col("n") / block).cast("int")
        placed = dealt.join(met, keys).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        # A row meets its own block and each other one.
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        placed = placed.select(
            *keys, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
            "block", "node", "copies", "vector", "cells",
        )
        links = placed.groupBy(*keys, "low", "high").applyInArrow(
            _group(least, apart, least_count(recall=recall)), "node long, root long, links long"
        )
        return settled(links, "vector-links")

    found = reduce(DataFrame.unionByName, map(linked, parts))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = settled(
        nodes.join(counts, "node", "left").join(grouped, "node", "left").select(
            "label", "vector", "first", F.coalesce("root", "node").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "vector-known",
    )
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = settled(known.join(smallest, "root").select("label", "vector", "n_links", "component_id"), "vector-components")
    single = F.col("n_links").isNull()
    # A vector of very many copies is split by the adaptive skew join.
    out = rows.join(known, ["label", "vector"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(single, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
