"""Quality rules as weak supervision: rules vote or abstain, and a mixture model weighs them.

Each rule looks at one feature of a text and votes good, bad, or abstains. Expectation-maximisation over the
counts of vote patterns estimates how many texts are good and how often each rule's votes are right; the posterior of a
text's pattern replaces the demand that all rules pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechprep.llm.common import SPACE, WORD, text_or_empty
from speechprep.operators.once import once
from speechprep.session import settled

WINDOW = 5
SYMBOLS = "#*$%&|<>"
GOOD, BAD, ABSTAIN = 1, 0, -1
#: Where estimation starts, pseudo-counts of right and wrong votes, and the range that accuracies keep to: a rule
#: is trusted more than a coin and never fully.
START, RIGHT, WRONG, RANGE = 0.9, 9.0, 1.0, (0.55, 0.99)
#: The range that the share of good texts keeps to.
PRIOR = (0.05, 0.95)
ROUNDS = 50


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside windows that occur twice or more; ``hashes`` are those of the windows by start.

    Texts without a repeated window are known by the number of distinct hashes. Else the starts of repeated
    windows are put in order, and each covers its words up to the next start.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(sorted_pairs: Column) -> Column:
        same = lambda x, i: (F.get(sorted_pairs, i - 1)["h"] == x["h"]) | (F.get(sorted_pairs, i + 1)["h"] == x["h"])
        repeated = F.filter(sorted_pairs, lambda x, i: F.coalesce(same(x, i), F.lit(False)))
        return F.sort_array(F.transform(repeated, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0), lambda total, n: total + n)

    # transform over one value names it, so that it is computed once.
    named = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    counted = named(pairs, lambda s: named(starts(s), covered))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(counted).cast("long")


def _among(text: Column, characters: str) -> Column:
    """How many code points of a text are among these: what is left when runs of others are cut out."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def text_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that the rules read, one row per row; null text has no words.

    Windows of words are compared by a 64-bit hash of their words' 64-bit hashes, inside one text.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    rows = once(rows, words=F.array_remove(F.split("t", f"{SPACE}+"), ""))
    rows = once(rows, hashes=F.transform("words", lambda w: F.xxhash64(w)))
    h = F.col("hashes")
    starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
    window = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    no_window = F.array().cast("array<bigint>")
    rows = once(
        rows,
        windows=F.when(F.size(h) >= WINDOW, F.transform(starts, window)).otherwise(no_window),
        lines=F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD)),
        n_distinct=F.size(F.array_distinct("hashes")),
        joined=F.array_join("words", ""),
    )
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length("joined").cast("long").alias("word_chars"),
        _among(F.col("t"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.col("windows")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.col("n_distinct").cast("long").alias("n_distinct"),
        _among(F.col("joined"), r"\p{L}").alias("n_letters"),
        _among(F.col("joined"), r"\p{Lu}").alias("n_upper"),
        _among(F.col("joined"), "!?").alias("n_calls"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_votes() -> dict[str, Column]:
    """The rules, as votes over the features of ``text_features``.

    All read shares, so long texts vote like short ones. Most only know what is bad.
    """

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))

    def vote(bad: Column, good: Column | None = None) -> Column:
        out = F.when(bad, BAD)
        return (out if good is None else out.when(good, GOOD)).otherwise(ABSTAIN).cast("int")

    symbols, upper = share("n_symbols", "n_words"), share("n_upper", "n_letters")
    letters, calls = share("n_letters", "word_chars"), share("n_calls", "n_words")
    length, long_enough = share("word_chars", "n_words"), F.col("n_words") >= 50
    return {
        "symbols": vote(symbols > 0.3, symbols < 0.05),
        "letters": vote(letters < 0.5, letters > 0.9),
        "capitals": vote(upper > 0.5),
        "calls": vote(calls > 0.3),
        "lines": vote((share("n_dup_lines", "n_lines") > 0.3) & (F.col("n_dup_lines") > 2)),
        "repeats": vote(long_enough & (share("n_repeat_words", "n_words") > 0.15)),
        "variety": vote(long_enough & (share("n_distinct", "n_words") < 0.1)),
        "length": vote((length < 2) | (length > 20)),
    }


def fit_accuracies(
    patterns: list[dict], rules: list[str], rounds: int = ROUNDS
) -> tuple[dict[str, float], float]:
    """How often each rule's votes are right, and the share of good texts, by expectation-maximisation.

    ``patterns`` has the distinct vote patterns with their counts ``n``: at most 3 to the number of rules,
    whatever the corpus. Abstaining says nothing. The share keeps to PRIOR.
    """
    accuracy, prior = dict.fromkeys(rules, START), 0.5
    for _ in range(rounds):
        right, voted = dict.fromkeys(rules, RIGHT), dict.fromkeys(rules, RIGHT + WRONG)
        good_texts, texts = 1.0, 2.0
        for pattern in patterns:
            good = good_given(pattern, accuracy, prior)
            good_texts += pattern["n"] * good
            texts += pattern["n"]
            for r in rules:
                if pattern[r] != ABSTAIN:
                    voted[r] += pattern["n"]
                    right[r] += pattern["n"] * (good if pattern[r] == GOOD else 1 - good)
        accuracy = {r: min(max(right[r] / voted[r], RANGE[0]), RANGE[1]) for r in rules}
        prior = min(max(good_texts / texts, PRIOR[0]), PRIOR[1])
    return accuracy, prior


def good_given(pattern: dict, accuracy: dict[str, float], prior: float) -> float:
    """Probability of being good given the votes of a pattern."""
    odds = math.log(prior / (1 - prior))
    for r, a in accuracy.items():
        if pattern[r] != ABSTAIN:
            odds += (2 * pattern[r] - 1) * math.log(a / (1 - a))
    return 1 / (1 + math.exp(-odds))


def posterior(accuracy: dict[str, float], prior: float) -> Column:
    """``good_given`` the vote columns."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for r, a in accuracy.items():
        weight = math.log(a / (1 - a))
        odds = odds + F.when(F.col(r) == GOOD, weight).when(F.col(r) == BAD, -weight).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per row of ``df``: doc_id, the counts, base_failed, p_good, kept, and each rule's vote.

    * Null and empty texts have no words and fail the base rules.
    * kept: the base rules pass and p_good is at least ``least``.
    * Repeated rows vote once each. An empty table gives an empty result. Other columns are not read.

    Runs jobs when called: the features are written once, and the counts of vote patterns (at most 3 to the
    number of rules) come to the driver.
    """
    votes = rule_votes()
    features = settled(text_features(df, id_col, text_col).withColumns(votes), "rule-votes")
    rules = list(votes)
    patterns = features.groupBy(*rules).agg(F.count("*").alias("n")).orderBy(*rules).collect()
    p_good = posterior(*fit_accuracies([row.asDict() for row in patterns], rules))
    return (
        features.withColumns({"base_failed": base_failed(), "p_good": p_good})
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            "p_good", *[F.col(r).alias(f"vote_{r}") for r in rules],
        )
    )
