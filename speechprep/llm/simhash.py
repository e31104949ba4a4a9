"""Near duplicates by SimHash, linked by meeting in the middle.

Two fingerprints differ in at most 2 r bits exactly if some number differs from each of them in at most r bits.
So each fingerprint emits all numbers within r = 2 bits of it, and those that emit the same number are linked.
Of a variant, only the bits that choose its shuffle bucket are made before the shuffle; the other bits are
flipped inside the bucket, where equal variants are found by sorting. Every variant is made once, in one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechprep.llm.common import placed_rows, whole_rows
from speechprep.llm.components import components
from speechprep.session import settled

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
HALF = RADIUS // 2
BALL = sum(comb(BITS, k) for k in range(HALF + 1))
#: Variants to sort at once in a bucket. Buckets are made so many that they have about as many on average.
AT_ONCE = 2_000_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    size = min(shingle, len(words))
    ends = starts[size:]
    digest, n = xxhash.xxh64_digest, len(words) - size + 1
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        hashes = b"".join([digest(line[a : b - 1], SEED) for a, b in zip(starts[at : min(n, at + CHUNK)], ends[at:])])
        # Digests are big-endian: the first byte has the highest bits.
        set_bits += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carry: str | None = None
) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and text_hash, one row per row; ``at`` is the column ``carry``."""
    kept = ["doc_id", "text_hash"] + ([] if carry is None else ["at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(marks)], [*kept, "fp"])

    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"),
        *([] if carry is None else [F.col(carry).alias("at")]),
    )
    return rows.mapInArrow(run, T.StructType([*rows.select(*kept).schema, T.StructField("fp", T.LongType())]))


def bucket_bits(marks: DataFrame, at_once: int = AT_ONCE) -> list[int]:
    """The bit positions that choose a bucket: more for more fingerprints, and those that part them most evenly."""
    bit = lambda k: F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1).cast("long"))
    row = marks.agg(F.count("*").alias("n"), *[F.sum(bit(k)).alias(f"b{k}") for k in range(BITS)]).first()
    count = max(0, int(row.n * BALL / at_once).bit_length())
    even = sorted(range(BITS), key=lambda k: (abs(2 * (row[f"b{k}"] or 0) - row.n), k))
    return sorted(even[:count])


def _bucket(bits: list[int]) -> Column:
    parts = [
        F.shiftleft(F.shiftrightunsigned("fp", bit).bitwiseAND(F.lit(1).cast("long")), k) for k, bit in enumerate(bits)
    ]
    out = F.lit(0).cast("long")
    for part in parts:
        out = out.bitwiseOR(part)
    return out


def _flips(bits: list[int], most: int) -> list[int]:
    """All masks of at most ``most`` of these bits."""
    return [sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(bits, k)]


def _meet(fps: np.ndarray, bucket: int, bits: list[int], at_once: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as positions in sorted ``fps``) between those that share a variant in this bucket.

    Members of one variant are all within the radius of each other, so each is linked to the smallest; of all
    links of the bucket a forest is returned.
    """
    label = np.arange(len(fps))
    here = sum(1 << b for k, b in enumerate(bits) if bucket >> k & 1)
    for a, b in _variants(fps, np.arange(len(fps)), bits, here, at_once):
        label = _join(label, a, b)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return moved, label[moved]


def _variants(
    fps: np.ndarray, own: np.ndarray, bits: list[int], here: int, at_once: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the fingerprints ``own`` that share a variant with these bits as in ``here``.

    Too many variants to sort at once are parted by one more bit, the one that parts the fingerprints most evenly, so
    that each variant is made once however crowded a bucket is.
    """
    chosen = np.uint64(sum(1 << b for b in bits))
    away = np.bitwise_count((fps[own] & chosen) ^ np.uint64(here))
    rest = [b for b in range(BITS) if b not in set(bits)]
    left = [own[away == d] for d in range(HALF + 1)]
    sizes = [sum(comb(len(rest), k) for k in range(HALF - d + 1)) for d in range(HALF + 1)]
    total = sum(len(o) * n for o, n in zip(left, sizes))
    own = np.concatenate(left)
    if len(own) < 2:
        return
    if total > at_once and len(rest) > HALF:
        set_bits = [int((fps[own] >> np.uint64(b) & np.uint64(1)).sum()) for b in rest]
        more = rest[int(np.argmin(np.abs(2 * np.array(set_bits) - len(own))))]
        yield from _variants(fps, own, [*bits, more], here, at_once)
        yield from _variants(fps, own, [*bits, more], here | 1 << more, at_once)
        return
    made, owner = [], []
    for d, owners in enumerate(left):
        masks = np.array(_flips(rest, HALF - d), np.uint64)
        made.append((((fps[owners] & ~chosen) | np.uint64(here))[:, None] ^ masks[None, :]).ravel())
        owner.append(np.repeat(owners, len(masks)))
    variant, whose = np.concatenate(made), np.concatenate(owner)
    order = np.argsort(variant)
    variant, whose = variant[order], whose[order]
    same = variant[1:] == variant[:-1]
    if not same.any():
        return
    inside = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    first = inside & ~np.concatenate([[False], same])
    whose, first = whose[inside], first[inside]
    starts = np.flatnonzero(first)
    smallest = np.minimum.reduceat(whose, starts)[np.cumsum(first) - 1]
    pairs = np.unique(whose * len(fps) + smallest)
    a, b = pairs // len(fps), pairs % len(fps)
    near = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS)
    yield a[near], b[near]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the trees of each pair: labels become the smallest of a component."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_links(marks: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``marks`` (distinct ``fp``) within the radius.

    Rows grow with the fingerprints times the variants of a bucket number; a bucket's fingerprints stay about
    as many at any size, since buckets grow in number with the table. A crowded bucket is parted by further bits.
    """
    bits = bucket_bits(marks, at_once)
    masks = F.array(*[F.lit(m).cast("long") for m in _flips(list(range(len(bits))), HALF)])
    dealt = marks.select("fp", F.explode(masks).alias("mask")).select(
        _bucket(bits).bitwiseXOR(F.col("mask")).alias("bucket"), "fp"
    )

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        fps = np.sort(group.column("fp").to_numpy().view(np.uint64))
        a, b = _meet(fps, key[0].as_py(), bits, at_once)
        signed = fps.view(np.int64)
        return pa.table({"a": signed[a], "b": signed[b]})

    return dealt.groupBy("bucket").applyInArrow(meet, "a long, b long")


def simhash_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carry: str | None = None
) -> DataFrame:
    """One row per row of ``df``: doc_id, text_hash, fp, root, component_id, and ``at``, the column ``carry``.

    Texts are lower-cased (A-Z); shingles of words are hashed with XXH64 (seed 42), repeats included; texts
    with fewer words are one shingle, and texts without words, null included, have fingerprint 0 and are linked
    like any other. Fingerprints at 4 or fewer differing bits are linked. component_id is the smallest doc_id
    that links lead to, null only if none there has one. Equal texts share a fingerprint and are worked on
    once. An empty table gives an empty result; other columns are not read.
    """
    rows = settled(fingerprints(df, id_col, text_col, shingle, carry), "fingerprints")
    marks = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    links = settled(near_links(marks.select("fp")), "near-links")
    groups = components(links).select(F.col("node").alias("fp"), "root")
    rooted = settled(
        marks.join(groups, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted"
    )
    smallest = settled(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    known = settled(rooted.join(smallest, "root").select("fp", "root", "component_id"), "groups-by-fingerprint")
    # A fingerprint of very many copies is split by the adaptive skew join: both sides are written tables.
    shown = ["doc_id", "text_hash", "fp", "root", "component_id"]
    return rows.join(known, "fp").select(*shown, *([] if carry is None else ["at"]))


def hex_digits(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def drop_near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """The row with the smallest doc_id of each group (null last; ties by a hash of the text), with all columns.

    Decided on narrow rows; whole rows are shuffled once. Of rows alike in id and text any one stays.
    """
    placed = placed_rows(df, "near-input")
    narrow = placed.select("at", F.col("row")[id_col].alias("doc_id"), F.col("row")[text_col].alias("text"))
    found = simhash_groups(narrow, shingle=shingle, carry="at")
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("key"), "text_hash", "at")
    first = found.groupBy("root").agg(F.min(order).alias("o"))
    return whole_rows(placed, settled(first.select("o.at"), "near-kept")).select("row.*")
