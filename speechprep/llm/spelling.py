"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word's letters with repeats are a binary vector: one place for each letter and occurrence of it. Words that differ
by one inserted or deleted letter differ in one place, by a replaced one in at most two. The places are dealt to PARTS
parts; two vectors within a Hamming distance of RADIUS agree in all but at most RADIUS parts. So each word has one
signature for each choice of RADIUS parts left out, made of the places in the other parts, and near words share at
least one. Signatures are joined by equality, and each pair that meets is verified letter by letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechprep.session import settled

PARTS, RADIUS = 8, 2
LEFT_OUT = list(combinations(range(PARTS), RADIUS))
#: Letters are A-Z, a-z and U+00C0 to U+00FF: one byte each in Latin-1. A-Z become a-z, all else ends a word.
RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
LEAST_LETTERS, LEAST_N, RATIO, SLIP = 6, 5, 5, 199
#: A task counts so many words, of at most so many letters, before it hands its counts on.
COUNTED, COUNTED_LETTERS = 250_000, 64
#: Letters of the words whose signatures are made at once.
AT_ONCE = 1 << 17
#: The letters at either end that are compared before a pair is verified: one edit in words of LEAST_LETTERS leaves
#: either the first or the last half as it is.
END = LEAST_LETTERS // 2


def letter_runs(text: str) -> list[bytes]:
    """The runs of letters of a text, in Latin-1, A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(RUNS).split()


def slipped(run: bytes, doc: int, every: int) -> bytes:
    """The run, without one letter if ``every`` divides its checksum; ``doc`` is the checksum of what stands before."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), doc)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    df: DataFrame, id_col: str, text_col: str, least_letters: int = LEAST_LETTERS, every: int | None = SLIP
) -> DataFrame:
    """(word, n): words of at least so many letters and how often they occur; counted in each task before the shuffle."""

    def batch_of(items: list[tuple[bytes, int]]) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w, _ in items], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array([n for _, n in items], pa.int64())], ["word", "n"])

    def out(seen: Counter) -> Iterator[pa.RecordBatch]:
        items = iter(seen.items())
        while some := list(islice(items, 20_000)):
            yield batch_of(some)
        seen.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                # Shorter runs cannot become words: a slip only takes a letter away.
                runs = Counter([r for r in letter_runs(text.as_py() or "") if len(r) >= least_letters])
                if every:
                    start, whole = zlib.crc32(f"{doc.as_py()}:".encode() if doc.is_valid else b":"), runs
                    runs = Counter()
                    for run, n in whole.items():
                        word = slipped(run, start, every)
                        if len(word) >= least_letters:
                            runs[word] += n
                if long := [(w, n) for w, n in runs.items() if len(w) > COUNTED_LETTERS]:
                    for item in long:
                        yield batch_of([item])
                        del runs[item[0]]
                seen.update(runs)
                if len(seen) > COUNTED:
                    yield from out(seen)
        yield from out(seen)

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number (wraps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature_matrix(words: list[str]) -> np.ndarray:
    """One row a word (none empty), one signature for each of LEFT_OUT."""
    sizes = np.array([len(w) for w in words])
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    order = np.lexsort((letters, owner))
    letters = letters[order]
    place = np.arange(len(letters))
    new = np.ones(len(letters), bool)
    new[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    occurrence = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    element = _mixed((letters << np.uint64(32)) + occurrence + np.uint64(0x9E3779B97F4A7C15))
    part = _mixed(element) % np.uint64(PARTS)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    sums = [np.add.reduceat(np.where(part == p, element, np.uint64(0)), starts) for p in range(PARTS)]
    whole = np.sum(sums, axis=0, dtype=np.uint64)
    # The parts left out tell signatures of different choices apart.
    return np.stack(
        [_mixed(whole - sums[a] - sums[b] + np.uint64(k)) for k, (a, b) in enumerate(LEFT_OUT)], axis=1
    )


def signatures(words: DataFrame) -> DataFrame:
    """(sig, word, n, head, tail) for words (word, n): one row for each choice of parts left out."""

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        start = held = 0
        for k, word in enumerate(batch.column(0)):
            held += len(word.as_py())
            if held >= AT_ONCE:
                yield batch.slice(start, k + 1 - start)
                start, held = k + 1, 0
        yield batch.slice(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch):
                if not some.num_rows:
                    continue
                words = some.column(0).to_pylist()
                found = signature_matrix(words)
                ends = [[pa.array([w[:END] for w in words]), pa.array([w[-END:] for w in words])]]
                rows = pa.array(np.repeat(np.arange(len(words)), len(LEFT_OUT)))
                columns = [c.take(rows) for c in (some.column(0), some.column(1), *ends[0])]
                sig = pa.array(found.ravel().view(np.int64))
                yield pa.RecordBatch.from_arrays([sig, *columns], ["sig", "word", "n", "head", "tail"])

    return words.select("word", "n").mapInArrow(run, "sig long, word string, n long, head string, tail string")


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a < b: each pair of words (word, n) that one inserted, deleted or replaced letter tells apart.

    Words must have LEAST_LETTERS or more. A crowded signature is split by the adaptive skew join.
    """
    signed = settled(signatures(words), "spelling-signatures")
    x, y = signed.alias("x"), signed.alias("y")
    ends = (F.col("x.head") == F.col("y.head")) | (F.col("x.tail") == F.col("y.tail"))
    met = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.word") < F.col("y.word")) & ends)
    near = met.filter(F.levenshtein("x.word", "y.word", 1) == 1)
    return near.select(
        F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n")
    ).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words (word, form): where the forms lead to, by doubling.

    A form occurs at least RATIO times as often as its word, so chains are short (some 27 steps for 64-bit counts)
    and never close.
    """
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        at = settled(at, "spelling-roots")
        further = at.select(F.col("word").alias("w"), F.col("root").alias("next"))
        step = at.join(further, at.root == further.w, "left")
        if step.filter("next is not null").isEmpty():
            return at
        at = step.select("word", F.coalesce("next", "root").alias("root"))


def spelling_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_n: int = LEAST_N,
    ratio: int = RATIO,
    every: int | None = SLIP,
) -> DataFrame:
    """One row per word of the corpus: word, n, n_near, form, form_n, root.

    Words are runs of the letters A-Z, a-z, U+00C0 to U+00FF, A-Z lower-cased, with at least LEAST_LETTERS letters and
    ``least_n`` occurrences in all. ``every``: a run whose checksum (CRC32 of doc_id, colon and run) it divides loses
    one letter first; None leaves runs as they are. n_near counts words one edit away; form is the most frequent of
    these (ties: the smallest) if it occurs at least ``ratio`` times as often (2 or more), else null; root is where
    forms lead to. Null texts have no words, a null doc_id counts as empty text, repeated rows count each, and an
    empty table gives an empty result. Very long runs are words like any other. Other columns are not read.
    """
    words = settled(word_counts(df, id_col, text_col, LEAST_LETTERS, every).filter(F.col("n") >= least_n), "spelling-words")
    pairs = settled(near_words(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    often = -F.col("best.less") >= ratio * F.col("n")
    best = settled(
        best.select("word", "n_near", F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")),
        "spelling-forms",
    )
    ends = roots(best.filter("form is not null"))
    return (
        words.join(best, "word", "left").join(ends, "word", "left")
        .select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form",
            F.col("form_n").cast("long").alias("form_n"), F.coalesce("root", "word").alias("root"),
        )
    )
