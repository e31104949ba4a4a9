"""Ranked lexical search: accumulators over short lists, then document-at-a-time skipping over the long ones.

The documents are cut into blocks, and each block is an inverted index of the terms that the items ask for, written to
the shared folder. An item is answered block by block. Its short lists are added up term at a time into accumulators;
these then act as one more list, with the largest sum as its bound. That list and the long ones are walked document
after document, a run of documents at once: long lists that together cannot lift a document to the item's present
k-th best score bring no candidates, a candidate is dropped as soon as its sum and the bounds of the lists not yet
looked at fall below that score, and long lists are only entered at the candidates left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechprep.session import settled

#: Terms are runs of digits, letters A-Z and a-z, and all characters beyond ASCII; only A-Z are lower-cased.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
TOP = 20
#: A block ends at so many documents or postings.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 500_000
#: A list is short if it holds at most one in so many of a block's documents.
SHORT = 32
#: Documents walked at once.
RUN = 1024
#: Items are answered in passes of about so many characters of their texts.
PASS_CHARS = 8_000_000
#: Tasks hand on their best rows to so many groups for each item before these meet.
GROUPS = 64
BLOCKS = (
    "n_docs long, n_terms long, ids array<long>, sizes array<long>,"
    " terms array<int>, dfs array<int>, docs array<int>, tfs array<int>"
)


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERMS).split()


class _Block:
    """An inverted index in the making."""

    def __init__(self):
        self.n_docs = self.n_terms = self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc: int | None, words: list[bytes], numbers: dict[bytes, int]) -> None:
        self.n_docs += 1
        self.n_terms += len(words)
        found = [(numbers[w], n) for w, n in Counter(words).items() if w in numbers]
        if found:
            self.rows.append((doc is None, doc or 0, len(words), found))
            self.held += len(found)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_DOCS or self.held >= BLOCK_POSTINGS

    def table(self) -> pa.RecordBatch:
        # Documents in order of doc_id, null last, so that places order ties.
        rows = sorted(self.rows, key=lambda r: r[:2])
        postings = np.array([(t, at, n) for at, r in enumerate(rows) for t, n in r[3]], np.int64).reshape(-1, 3)
        postings = postings[np.argsort(postings[:, 0], kind="stable")]
        terms, dfs = np.unique(postings[:, 0], return_counts=True)
        lists = [
            pa.array([[None if none else i for none, i, _, _ in rows]], pa.list_(pa.int64())),
            pa.array([[size for _, _, size, _ in rows]], pa.list_(pa.int64())),
            *[pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (terms, dfs, postings[:, 1], postings[:, 2])],
        ]
        names = [field.split()[0] for field in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([self.n_docs]), pa.array([self.n_terms]), *lists], names)


def index_blocks(df: DataFrame, numbers: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of BLOCKS: inverted lists of the numbered terms over whole texts, and counts of all documents and terms."""
    shared = df.sparkSession.sparkContext.broadcast(numbers)  # the terms of one pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, block = shared.value, _Block()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                if words := terms_of(text.as_py() or ""):
                    block.add(doc.as_py(), words, numbers)
                    if block.full():
                        yield block.table()
                        block = _Block()
        if block.n_docs:
            yield block.table()

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, BLOCKS)


class Best:
    """The best k (score, null id, id) of an item so far; ``least`` is the score that a document must reach."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.rows = np.zeros((0, 3), np.int64)

    def add(self, scores: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([scores, none, ids], axis=1)])
        order = np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]
        self.rows = rows[order]
        if len(order) == self.k:
            self.least = max(1, int(self.rows[-1, 0]))


class Lists:
    """A block read back: scores of all postings, and each term's list with its bound."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.none, self.ids, self.n = row["none"], row["ids"], len(row["ids"])
        m = 100 - 25 + (25 * row["sizes"] * n_docs) // n_terms
        tfs, docs = row["tfs"].astype(np.int64), row["docs"]
        ends = np.cumsum(row["dfs"])
        starts = ends - row["dfs"]
        score = np.repeat(weights[row["terms"]], row["dfs"]) * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[docs]))
        bounds = np.maximum.reduceat(score, starts) if len(starts) else starts
        self.of = {
            t: (docs[a:b], score[a:b], int(most))
            for t, a, b, most in zip(row["terms"].tolist(), starts.tolist(), ends.tolist(), bounds)
        }


def search(lists: Lists, query: list[tuple[int, int]], best: Best) -> None:
    """Add a block's documents to an item's best; ``query`` has (term number, occurrences in the item)."""
    found = [(*lists.of[t], times) for t, times in query if t in lists.of]
    if sum(most * times for _, _, most, times in found) < best.least:
        return
    short = [x for x in found if len(x[0]) * SHORT <= lists.n]
    # Long lists by falling bound: what is left after each can add ``rest`` at most.
    long = sorted((x for x in found if len(x[0]) * SHORT > lists.n), key=lambda x: -x[2] * x[3])
    sums = np.zeros(lists.n, np.int64)
    for docs, scores, _, times in short:
        sums[docs] += scores * times  # a document is once in a list
    rest = np.cumsum([0] + [most * times for _, _, most, times in reversed(long)])[::-1]
    # Lists from here on cannot bring a document up by themselves.
    essential = next(k for k in range(len(long) + 1) if rest[k] < best.least)
    candidate = sums + rest[0] >= best.least
    candidate &= sums > 0
    for docs, *_ in long[:essential]:
        candidate[docs] = True
    walk = np.flatnonzero(candidate)
    for at in range(0, len(walk), RUN):
        docs = walk[at : at + RUN]
        score = sums[docs]
        for k, (listed, scores, _, times) in enumerate(long):
            alive = score + rest[k] >= best.least
            docs, score = docs[alive], score[alive]
            if not len(docs):
                break
            place = np.minimum(np.searchsorted(listed, docs), len(listed) - 1)
            score = score + np.where(listed[place] == docs, scores[place], 0) * times
        good = score >= best.least
        if good.any():
            docs = docs[good]
            best.add(score[good], lists.none[docs], lists.ids[docs])


def _numpy(array: pa.ListScalar) -> np.ndarray:
    return array.values.to_numpy(zero_copy_only=False)


def lexical_search(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = TOP,
) -> DataFrame:
    """The ``k`` best documents for each item: item_id, rank (from 1), doc_id, score.

    With N documents that have a term, L terms in them, n terms in a document and df documents with a term, a term weighs
    w = floor(1000 ln((2 N + 2) / (2 df + 1))), and a document that holds it tf times scores w times
    10**9 tf div (1000 tf + 12 m), m = 75 + 25 n N div L, for each occurrence of the term in the item. Equal scores
    stand by ascending doc_id, null last. Only scores above 0 count, so an item without terms has no rows. Null texts have no terms. Rows of documents
    are documents each, whatever their doc_id; rows of items that are alike in id and text are one item, and items
    of one id with different texts are ranked each. Empty tables give an empty result. Other columns are not read.

    Items are answered in passes, each an index over all documents for the terms of a bounded share of the items.
    Building the indexes runs when this is called.
    """
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    asked = settled(asked.distinct(), "search-items")
    chars = asked.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    passes = max(1, -(-chars // PASS_CHARS))
    out = None
    for number in range(passes):
        some = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number)
        found = _pass(df, some.toArrow(), id_col, text_col, k)
        out = found if out is None else out.unionByName(found)
    kind = asked.schema["item_id"].dataType
    return out.select(F.col("item_id").cast(kind), "rank", "doc_id", "score")


def _pass(df: DataFrame, items: pa.Table, id_col: str, text_col: str, k: int) -> DataFrame:
    spark = df.sparkSession
    numbers: dict[bytes, int] = {}
    queries = []
    for text in items.column("text").to_pylist():
        counts = Counter(terms_of(text))
        queries.append([(numbers.setdefault(t, len(numbers)), n) for t, n in counts.items()])
    index = settled(index_blocks(df, numbers, id_col, text_col), "search-index")
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    lists = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("l")).groupBy("l.terms").agg(F.sum("l.dfs").alias("df"))
    ratio = F.lit(2.0 * (n_docs or 0) + 2) / (2 * F.col("df") + 1).cast("double")
    # One number for each term that the pass asks for.
    known = lists.select("terms", F.floor(1000 * F.log(ratio)).cast("long").alias("weight")).toArrow()
    weights = np.zeros(len(numbers) + 1, np.int64)
    weights[known.column("terms").to_numpy()] = known.column("weight").to_numpy()
    shared = spark.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        best = [Best(k) for _ in queries]
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: _numpy(batch.column(name)[r]) for name in ("sizes", "terms", "dfs", "docs", "tfs")}
                ids = batch.column("ids")[r].values
                row |= {"none": ids.is_null().to_numpy(zero_copy_only=False), "ids": ids.fill_null(0).to_numpy(zero_copy_only=False)}
                lists = Lists(row, weights, n_docs, n_terms)
                for query, found in zip(queries, best):
                    search(lists, query, found)
        for item, found in enumerate(best):
            if len(found.rows):
                score, none, ids = found.rows.T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), item)), pa.array(ids, mask=none.astype(bool)), pa.array(score)],
                    ["item", "doc_id", "score"],
                )

    blocks = index.select("ids", "sizes", "terms", "dfs", "docs", "tfs")
    rows = blocks.mapInArrow(run, "item long, doc_id long, score long").withColumn(
        "part", F.pmod(F.spark_partition_id(), F.lit(GROUPS))
    )
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item", "part"], ["item"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    names = spark.createDataFrame(
        pa.table({"item": pa.array(range(len(items)), pa.int64()), "item_id": items.column("item_id")})
    )
    return rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
