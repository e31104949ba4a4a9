"""Quality by ordinal regression: one direction in hashed text, ordered thresholds for the grades.

P(grade >= k) = sigmoid(w . x - t_k) with t_1 <= t_2 <= ...: all grades share the weights. The fit reads a bounded
sample with as many texts of a rare grade as of a common one; each weighs what it stands for, and scale and
thresholds are set anew on rows kept out of the fit, so that probabilities are those of the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechprep.llm.common import chosen_by_hash, collected_features
from speechprep.llm.hashed_text import gram_counts
from speechprep.session import settled

ORDERS, GRAM_BITS = (1, 2, 3), 16
EXTRA = 3
#: The bound on the rows that are fitted: so many of each grade.
PER_GRADE = 1500
EPOCHS, RATE, DECAY = 8, 0.5, 1e-5
#: Steps of the calibration, and the share of sampled rows kept out for it: one in so many.
ROUNDS, KEPT_OUT = 300, 4


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams (square roots of shares), and shares of words and lines that repeat.

    Case is kept. Positions after the n-gram buckets: a word like the one before it, a line seen before, always 1.
    """
    used, counts = gram_counts(text, ORDERS, GRAM_BITS)
    values = np.sqrt(counts / counts.sum()) if len(counts) else np.zeros(0)
    words = text.split()
    again = sum(map(eq, words, words[1:])) / max(1, len(words) - 1)
    lines = text.split("\n")
    repeated = 1 - len(set(lines)) / len(lines)
    base = 1 << GRAM_BITS
    return np.append(used, [base, base + 1, base + 2]), np.append(values, [again, repeated, 1.0])


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _slopes(above: np.ndarray, grade: int) -> tuple[float, np.ndarray]:
    """Of log P(grade): the derivatives by the score and by each threshold.

    ``above`` is P(grade >= k) for k = 0 (1) to the number of grades (0).
    """
    p = max(above[grade] - above[grade + 1], 1e-9)
    density = above * (1 - above)
    by_cut = np.zeros(len(above) - 2)
    if grade > 0:
        by_cut[grade - 1] = -density[grade] / p
    if grade < len(by_cut):
        by_cut[grade] = density[grade + 1] / p
    return 1 - above[grade] - above[grade + 1], by_cut


def fit_ordinal(samples: list[tuple[np.ndarray, np.ndarray, int, float]], grades: int, seed: int = 5):
    """Weights and ordered thresholds by stochastic gradient ascent with per-coordinate steps.

    ``samples`` has positions, values, grade and how much the row weighs (1 on average).
    """
    w = np.zeros((1 << GRAM_BITS) + EXTRA)
    seen = np.full_like(w, 1e-2)
    cuts = np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(grades - 1)
    order = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        for k in order.permutation(len(samples)):
            used, values, grade, weighs = samples[k]
            above = np.concatenate([[1.0], _sigmoid(values @ w[used] - cuts), [0.0]])
            slope, by_cut = _slopes(above, grade)
            g = weighs * slope * values - DECAY * w[used]
            seen[used] += g * g
            w[used] += RATE * g / np.sqrt(seen[used])
            cuts = np.maximum.accumulate(cuts + RATE / 10 / (1 + epoch) * weighs * np.clip(by_cut, -5, 5))
    return w, cuts


def calibrate(scores: np.ndarray, labels: np.ndarray, weighs: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray]:
    """The scale of scores and the thresholds with the best weighted log likelihood, by gradient ascent.

    Few numbers are fitted on rows that the weights have not seen. Their start holds if there is nothing to learn from.
    """
    scale, rate = 1.0, 0.5
    seen = np.full(1 + len(cuts), 1e-2)
    for _ in range(ROUNDS if len(scores) else 0):
        above = _sigmoid(scale * scores[:, None] - cuts[None, :])
        above = np.hstack([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))])
        slopes = [_slopes(a, g) for a, g in zip(above, labels)]
        by_score = np.array([s for s, _ in slopes]) * weighs
        step = np.concatenate([[by_score @ scores], weighs @ np.array([c for _, c in slopes])]) / len(scores)
        seen += step * step
        step = rate * step / np.sqrt(seen)
        scale = max(1e-3, scale + step[0])
        cuts = np.maximum.accumulate(cuts + step[1:])
    return scale, cuts


def fit_quality(
    df: DataFrame,
    ratings: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    grade_col: str = "grade",
    per_grade: int = PER_GRADE,
):
    """Weights and thresholds from at most ``per_grade`` rated texts of each grade, chosen by a hash of the id.

    A text weighs as many rated texts of its grade as it stands for.

    ``ratings`` has doc_id and a grade from 0; null ids or grades are left out, and of several grades for one id
    the smallest counts. An id that several rows share is fitted once. (None, none) without two grades.
    """
    graded = ratings.select(
        F.col("doc_id").cast("long").alias("key"), F.col(grade_col).cast("int").alias("grade")
    ).dropna()
    graded = graded.groupBy("key").agg(F.min("grade").alias("grade")).withColumn("h", F.xxhash64("key", F.lit("fit")))
    chosen = settled(chosen_by_hash(graded, "grade", per_grade), "rated")
    texts = df.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # At most per_grade rows of each grade.
    rated = texts.join(F.broadcast(chosen), "key").dropDuplicates(["key"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())),
                 pa.array([p[1].astype(np.float32) for p in pairs], pa.list_(pa.float32()))],
                ["h", "label", "used", "value"],
            )

    sampled = collected_features(rated.select("h", "grade", "text").mapInArrow(
        extract, "h long, label int, used array<int>, value array<float>"
    ))
    labels = [grade for _, _, grade in sampled]
    if len(set(labels)) < 2:
        return None, np.zeros(0)
    # One number for each grade that was sampled.
    rated_in_all = {r.grade: r["count"] for r in graded.filter(F.col("grade").isin(list(set(labels)))).groupBy("grade").count().collect()}
    stands_for = {g: rated_in_all[g] / labels.count(g) for g in set(labels)}
    mean = sum(rated_in_all.values()) / len(labels)
    samples = [(used, value, g, stands_for[g] / mean) for used, value, g in sampled]
    fit, apart = [s for k, s in enumerate(samples) if k % KEPT_OUT], samples[::KEPT_OUT]
    if len({s[2] for s in fit}) < len(set(labels)) or len({s[2] for s in apart}) < len(set(labels)):
        return fit_ordinal(samples, max(labels) + 1)  # too few to keep any out
    w, cuts = fit_ordinal(fit, max(labels) + 1)
    scores = np.array([x @ w[at] for at, x, _, _ in apart])
    scale, cuts = calibrate(scores, np.array([s[2] for s in apart]), np.array([s[3] for s in apart]), cuts)
    return w * scale, cuts


def tails(model, text: str | None) -> np.ndarray:
    """P(grade >= 1), P(grade >= 2), ... of a text; just 1 if nothing was fitted."""
    w, cuts = model
    if w is None:
        return np.ones(1)
    at, x = features(text or "")
    return _sigmoid(x @ w[at] - cuts)


def _tail(probabilities: np.ndarray, grade: int) -> float:
    return float(probabilities[grade - 1]) if grade <= len(probabilities) else 0.0


def quality_classifier(
    df: DataFrame,
    ratings: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    grade_col: str = "grade",
    per_grade: int = PER_GRADE,
    least_grade: int = 1,
    least: float = 0.5,
) -> DataFrame:
    """One row per row of ``df``: doc_id, expected_grade, tail (P(grade >= k) for k = 1, 2, ...), selected.

    The fit is bounded (see ``fit_quality``) and runs when this is called; every row is graded from its whole
    text. selected: P(grade >= least_grade) is at least ``least``. Null texts are graded as empty ones. Repeated
    rows get equal grades. Without two grades to tell apart, P is 1 and all rows are selected. Other columns are
    not read.
    """
    model = df.sparkSession.sparkContext.broadcast(fit_quality(df, ratings, id_col, text_col, grade_col, per_grade))

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tails(model.value, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([float(t.sum()) for t in found], pa.float64()),
                 pa.array(found, pa.list_(pa.float64())),
                 pa.array([_tail(t, least_grade) >= least for t in found], pa.bool_())],
                ["doc_id", "expected_grade", "tail", "selected"],
            )

    whole = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return whole.mapInArrow(grade, "doc_id long, expected_grade double, tail array<double>, selected boolean")


def select_quality(
    df: DataFrame,
    ratings: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    grade_col: str = "grade",
    least_grade: int = 1,
    least: float = 0.5,
) -> DataFrame:
    """The rows of ``df`` that ``quality_classifier`` selects, with all their columns, without a shuffle."""
    model = df.sparkSession.sparkContext.broadcast(fit_quality(df, ratings, id_col, text_col, grade_col))
    at = df.columns.index(text_col)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_tail(tails(model.value, t.as_py()), least_grade) >= least for t in batch.column(at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return df.mapInArrow(select, df.schema)
