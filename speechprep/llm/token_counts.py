"""Token counts of a byte-level BPE vocabulary without making tokens.

A piece of text starts as its bytes. The adjacent pair of lowest rank is merged again and again (a heap of
pairs over a linked list of symbols); the count is the number of bytes minus the number of merges.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechprep.llm.common import worker_store

#: The library's white space, which unlike Python's has no control separators.
BLANK = r"\t-\r \x85\xa0  -     　"
#: Runs that no piece crosses: text with one space before it, or white space.
RUNS = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: The split of byte-level BPE, for the inside of a run.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+"
)
#: Runs to remember in a worker, and the longest of them.
REMEMBERED, LONGEST = 1_000_000, 60


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable ones as they are, others from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


def load_merges(text: str) -> dict:
    """From a tokenizer's JSON: rank and product of each pair of symbols (as numbers), and the special strings."""
    spec = json.loads(text)
    number = {c: b for b, c in enumerate(byte_letters())}
    ranks = {}
    for rank, (left, right) in enumerate(spec["model"]["merges"]):
        made = number.setdefault(left + right, len(number))
        ranks.setdefault((number[left], number[right]), (rank, made))
    return {"ranks": ranks, "special": [t["content"] for t in spec.get("added_tokens", [])]}


def merged_count(piece: bytes, ranks: dict) -> int:
    """How many symbols are left of a piece when no adjacent pair can be merged any more."""
    symbol = list(piece)
    n = len(symbol)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if found := ranks.get((symbol[i], symbol[i + 1])):
            heap.append((found[0], i, found[1], symbol[i], symbol[i + 1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, made, left, right = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != left or j >= n or symbol[j] != right:
            continue  # one of the two has been merged since
        symbol[i], symbol[j] = made, -1
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if found := ranks.get((made, symbol[k])):
                heapq.heappush(heap, (found[0], i, found[1], made, symbol[k]))
        if (h := before[i]) >= 0 and (found := ranks.get((symbol[h], made))):
            heapq.heappush(heap, (found[0], h, found[1], symbol[h], made))
    return n - merges


class Counter(dict):
    """Tokens of a run, remembered up to a bound."""

    def __init__(self, ranks: dict):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, run: str) -> int:
        n = sum(merged_count(piece.encode(), self.ranks) for piece in PIECES.findall(run))
        if len(run) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[run] = n
        return n


def text_counter(merges: dict):
    """A function from a text to its number of tokens; special strings count as one each."""
    count = Counter(merges["ranks"]).__getitem__
    special = re.compile("|".join(map(re.escape, merges["special"]))) if merges["special"] else None

    def tokens(text: str) -> int:
        if special is None or not special.search(text):
            return sum(map(count, RUNS.findall(text)))
        parts = special.split(text)
        return len(parts) - 1 + sum(sum(map(count, RUNS.findall(part))) for part in parts)

    return tokens


def token_counts(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, n_tokens, over_limit.

    ``vocabulary`` is the text of a tokenizer's JSON file (a few MB); it is sent to the executors once. Whole
    texts are counted, without begin or end; special strings inside a text are one token each. Null and empty
    texts have no tokens. Repeated rows are counted each. Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    key = f"merges-{hash(vocabulary)}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("token_counters")
        if key not in store:
            store.clear()
            store[key] = text_counter(load_merges(shared.value))
        tokens = store[key]
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                counts.append(tokens(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
