"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned by follow-the-regularised-leader with an elastic-net penalty on a bounded sample of labelled
rows; document frequencies come from all rows that may be learned from. Rows kept out of the fit choose the penalty, the
strongest that loses next to nothing there, and a temperature that calibrates the probabilities. Weights are kept as
sparse rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechprep.llm.common import chosen_by_hash, collected_features
from speechprep.llm.hashed_text import gram_counts

ORDERS, GRAM_BITS = (1, 2, 3), 15
#: The bound on the rows that are fitted: so many of each language, and so many in all (then fewer of each, but not
#: fewer than LEAST_ROWS). Every language is fitted.
PER_LANGUAGE, FITTED, LEAST_ROWS = 800, 8000, 30
EPOCHS, ALPHA, BETA, L2 = 3, 0.5, 1.0, 1e-4
#: Penalties on the size of weights that are tried, strongest first, and the log loss that a stronger one may add.
PENALTIES, SLACK = (3.0, 1.0, 0.3, 0.1, 0.01), 0.01
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    return gram_counts(text.lower(), ORDERS, GRAM_BITS)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """How many rows there are and how many have each n-gram bucket; counted in each partition, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << GRAM_BITS) + 1, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total[_grams(value.as_py() or "")[0]] += 1
                total[-1] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((1 << GRAM_BITS) + 1, np.int64)
    for row in rows:  # at most the number of buckets
        total[row.bucket] = row.n
    return int(total[-1]), total[:-1]


def _weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used, counts = _grams(text)
    values = (1 + np.log(counts)) * idf[used]
    norm = np.sqrt(values @ values)
    return used, values / norm if norm else values


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, l1: float, seed: int = 7) -> np.ndarray:
    """Weights (bucket, class) by per-coordinate follow-the-regularised-leader."""
    z = np.zeros((1 << GRAM_BITS, classes))
    n = np.zeros_like(z)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in order.permutation(len(samples)):
            used, values, label = samples[k]
            zs, ns = z[used], n[used]
            w = weights(zs, ns)
            miss = _softmax(values @ w)
            miss[label] -= 1
            g = values[:, None] * miss[None, :]
            n[used] = grown = ns + g * g
            z[used] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * w
    return weights(z, n)


class SparseRows:
    """Weights as rows of (class, weight), zeros left out."""

    def __init__(self, weights: np.ndarray):
        rows, self.classes = np.nonzero(weights)
        self.weights = weights[rows, self.classes]
        self.ends = np.cumsum(np.bincount(rows, minlength=len(weights)))
        self.count = weights.shape[1]

    def logits(self, used: np.ndarray, values: np.ndarray) -> np.ndarray:
        ends = self.ends[used]
        starts = np.where(used > 0, self.ends[used - 1], 0)
        sizes = ends - starts
        before = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)
        return np.bincount(self.classes[at], np.repeat(values, sizes) * self.weights[at], self.count)


def fit_languages(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> SparseRows:
    """Weights under the strongest penalty whose log loss on the rows kept out is within SLACK of the best one's,
    divided by the temperature that fits there."""
    fit, kept_out = [s for k, s in enumerate(samples) if k % 5], samples[::5]
    labels = np.array([y for *_, y in kept_out], int)
    tried = []
    for l1 in PENALTIES:
        weights = fit_ftrl(fit or samples, classes, l1)
        logits = np.array([v @ weights[u] for u, v, _ in kept_out]).reshape(len(kept_out), classes)
        temperature = fit_temperature(logits, labels)
        tried.append((log_loss(logits / temperature, labels), weights / temperature))
    least = min(loss for loss, _ in tried)
    return SparseRows(next(weights for loss, weights in tried if loss <= least + SLACK))


def log_loss(logits: np.ndarray, labels: np.ndarray) -> float:
    top = logits.max(axis=1)
    return float(np.mean(top + np.log(np.exp(logits - top[:, None]).sum(axis=1)) - logits[np.arange(len(labels)), labels]))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits with the least log loss, searched on a fine grid of powers."""
    if not len(labels):
        return 1.0

    return float(min(np.exp2(np.linspace(-5, 5, 201)), key=lambda t: log_loss(logits / t, labels)))


def _sample(rows: DataFrame, per_language: int) -> DataFrame:
    """At most so many rows of each language, chosen by a hash of the id; texts move last."""
    languages = rows.select("lang").distinct().count()
    per_language = min(per_language, max(LEAST_ROWS, FITTED // max(1, languages)))
    narrow = rows.select("doc_id", "lang", F.xxhash64("doc_id", F.lit("fit")).alias("h")).distinct()
    chosen = chosen_by_hash(narrow, "lang", per_language)
    # At most FITTED rows of two numbers and a name, or LEAST_ROWS for each language; of several rows that share an id
    # one is fitted in a language, the one with the smallest hash of the text.
    found = rows.join(F.broadcast(chosen), ["doc_id", "lang"])
    first = Window.partitionBy("doc_id", "lang").orderBy(F.xxhash64("text"))
    return found.withColumn("first_", F.row_number().over(first)).filter("first_ = 1").drop("first_")


def language_id(
    df: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> DataFrame:
    """One row per row of ``df``: doc_id, lang_pred, score.

    ``learn`` tells which rows may be learned from; of these, rows with a language, an id and a text. The fit
    reads at most ``per_language`` rows of each language (whole texts), document frequencies read all of them.
    Every row is predicted from its whole text alone. ``und`` with score 0 is given to null texts, texts without
    letters, and, if there was nothing to learn from, to all. Repeated rows get equal predictions. Other columns
    are not read. Runs jobs when called.
    """
    rows = df.filter(learn).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    rows = rows.dropna()
    n_docs, frequency = document_frequencies(rows.select("text"))
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [_weighted(t.as_py(), idf) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())),
                 pa.array([p[1].astype(np.float32) for p in pairs], pa.list_(pa.float32()))],
                ["label", "h", "used", "value"],
            )

    sampled = _sample(rows, per_language).select("lang", "h", "text")
    sampled = collected_features(sampled.mapInArrow(features, "label string, h long, used array<int>, value array<float>"))
    names = sorted({lang for _, _, lang in sampled})
    if not names:
        return df.select(
            F.col(id_col).alias("doc_id"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")
        )
    number = {name: k for k, name in enumerate(names)}
    samples = [(used, value, number[lang]) for used, value, lang in sampled]
    weights = fit_languages(samples, len(names))
    # The weights that are not zero: at most buckets times languages.
    shared = df.sparkSession.sparkContext.broadcast((idf, weights, names))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, weights, names = shared.value
        for batch in batches:
            tags, scores = [], []
            for value in batch.column(1):
                text = value.as_py()
                if text is None or not LETTER.search(text):
                    tags.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                used, values = _weighted(text, idf)
                p = _softmax(weights.logits(used, values))
                tags.append(names[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tags, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    whole = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return whole.mapInArrow(predict, "doc_id long, lang_pred string, score double")
