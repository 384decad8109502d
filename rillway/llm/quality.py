"""Quality rules by weak supervision.

Each rule reads counts of a text and votes good (1), bad (-1) or abstains (0).  Expectation-
maximisation over the votes of all documents estimates the share of good documents and how often
each rule is right about good and about bad ones, without labels; a document is kept when its
posterior probability of being good reaches a threshold.  The base rules (too few words, too much
repetition) reject a document whatever the posterior, and such documents stay out of the estimation:
they are short or repetitive, but by the other rules look like good ones.  No rule reads what the
base rules leave constant, and no two rules read the same count.

A rule may be blind to what makes documents bad here, and then votes alike on both kinds.  So its
accuracies are only held to chance: where it would be right less often than wrong, it is made to say
nothing.  Estimation runs from several starts, and the one of greatest likelihood counts.

All counts are column expressions.  Votes enter the estimation as a histogram over vote patterns,
which has 3**7 rows at most whatever the number of documents.

Defined cases: a null text has no words, as an empty one; a ratio over nothing abstains; an empty
table fits the starting values; repeated rows count as often as they occur.  Columns of the input
are kept; the count columns are named as in COUNTS and replace columns of the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_distinct_words", "n_stops"]


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of COUNTS.

    Write the result out before filtering on a count: Catalyst would push the filter down and repeat
    the nested expressions in it.
    """
    kept = [df[c].alias(c) for c in df.columns if c not in COUNTS]
    t = F.coalesce(df[text], F.lit(""))
    squeezed = lambda c, pattern: F.length(F.regexp_replace(c, pattern, ""))
    df = df.select(
        *kept,
        F.array_remove(F.split(t, f"{SPACE}+"), "").alias("__words"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0).alias("__lines"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        squeezed(t, "[^\\p{L}]+").cast("long").alias("n_letters"),
        (F.length(t) - F.length(F.translate(t, ".!?。！？।؟", ""))).cast("long").alias("n_stops"),
    )
    w = F.col("__words")
    # the hash of the window of three words that starts at each word
    windows = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
    df = df.select("*", windows.alias("__windows"))
    h = F.col("__windows")
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.select("*", F.when(F.size(F.array_distinct(h)) < F.size(h), placed).alias("__placed"))
    p = F.col("__placed")
    twice = F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]))
    df = df.select("*", F.array_sort(F.transform(F.filter(twice, lambda x: x.isNotNull()), lambda x: x["i"])).alias("__at"))
    a = F.col("__at")
    # each repeated window adds the words up to the next one, three at most
    covered = F.aggregate(F.transform(a, lambda i, k: F.least(F.coalesce(F.get(a, k + 1) - i, F.lit(3)), F.lit(3))), F.lit(0), lambda x, y: x + y)
    return df.select(
        *[F.col(c) for c in df.columns if not c.startswith("__") and c not in COUNTS],
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        "n_letters",
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        "n_stops",
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def rules() -> dict[str, Column]:
    """Votes by rule name; a null share abstains."""
    n = F.col("n_words")
    length, symbols = _share("word_chars", "n_words"), _share("n_symbols", "n_words")
    lines, repeats = _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words")
    letters, distinct, stops = _share("n_letters", "word_chars"), _share("n_distinct_words", "n_words"), _share("n_stops", "n_words")
    return {
        "word_length": _vote((length >= 3) & (length <= 10), (length < 2) | (length > 20)),
        "few_symbols": _vote(symbols <= 0.1, symbols >= 0.3),
        "fresh_lines": _vote((lines <= 0.1) & (F.col("n_lines") >= 2), lines > 0.3),
        "fresh_windows": _vote(repeats <= 0.25, repeats > 0.5),
        "letters": _vote(letters >= 0.9, letters < 0.8),
        "vocabulary": _vote((distinct >= 0.2) & (n >= 20), (distinct < 0.05) & (n < 5000)),
        "sentences": _vote((stops >= 0.01) & (stops <= 0.5), (stops == 0) & (n >= 100)),
    }


@dataclass
class Model:
    """Share of good documents, and for each rule how often it is right about good and bad ones."""

    good: float
    right_good: list[float]
    right_bad: list[float]

    def log_odds(self, votes: dict[str, Column]) -> Column:
        out = F.lit(math.log(self.good / (1 - self.good)))
        for v, a, b in zip(votes.values(), self.right_good, self.right_bad, strict=True):
            out = out + F.when(v == 1, F.lit(math.log(a / (1 - b)))).when(v == -1, F.lit(math.log((1 - a) / b))).otherwise(F.lit(0.0))
        return out


#: Shares of good documents and accuracies of the rules from which the estimation starts.
STARTS = [(0.5, 0.6), (0.7, 0.75), (0.9, 0.8), (0.9, 0.95), (0.97, 0.9)]
#: Votes that each rule gets besides the ones seen, at PRIOR accuracy; they keep a rule that hardly votes near it.
PSEUDO_VOTES, PRIOR = 2.0, 0.8


def estimate(patterns: list[tuple[tuple[int, ...], int]], start: float, accuracy: float, rounds: int = 200) -> tuple[float, Model]:
    """Log-likelihood and model by expectation-maximisation from one start; patterns: votes, count."""
    k = len(patterns[0][0])
    clamp = lambda x: min(0.999, max(0.001, x))
    good, a, b = start, [accuracy] * k, [accuracy] * k
    before = -math.inf
    for _ in range(rounds):
        yes, no = [[0.0] * k for _ in range(2)], [[0.0] * k for _ in range(2)]  # by class: votes good, votes bad
        total = all_good = likelihood = 0.0
        for p, n in patterns:
            of_good, of_bad = math.log(good), math.log(1 - good)
            for j, v in enumerate(p):
                if v:
                    of_good += math.log(a[j] if v == 1 else 1 - a[j])
                    of_bad += math.log(1 - b[j] if v == 1 else b[j])
            top = max(of_good, of_bad)
            both = math.exp(of_good - top) + math.exp(of_bad - top)
            g = math.exp(of_good - top) / both
            total, all_good, likelihood = total + n, all_good + n * g, likelihood + n * (top + math.log(both))
            for j, v in enumerate(p):
                if v:
                    votes = yes if v == 1 else no
                    votes[0][j] += n * g
                    votes[1][j] += n * (1 - g)
        if likelihood - before < 1e-9 * abs(likelihood):
            break
        before = likelihood
        good = clamp(all_good / total)
        for j in range(k):
            a[j] = clamp((yes[0][j] + PSEUDO_VOTES * PRIOR) / (yes[0][j] + no[0][j] + PSEUDO_VOTES))
            b[j] = clamp((no[1][j] + PSEUDO_VOTES * PRIOR) / (yes[1][j] + no[1][j] + PSEUDO_VOTES))
            if a[j] + b[j] < 1:  # worse than chance: the same share of good votes for both
                a[j] = clamp((yes[0][j] + yes[1][j] + PSEUDO_VOTES / 2) / (yes[0][j] + yes[1][j] + no[0][j] + no[1][j] + PSEUDO_VOTES))
                b[j] = 1 - a[j]
    return likelihood, Model(good, a, b)


def fit(counted: DataFrame) -> Model:
    """The model of greatest likelihood, from the histogram of vote patterns (3**7 rows at most) of
    the documents that the base rules leave open; without any, that of the first start."""
    votes = rules()
    seen = counted.filter(~base_failed()).select([v.cast("tinyint").alias(k) for k, v in votes.items()]).groupBy(list(votes)).count().collect()
    patterns = sorted((tuple(r[k] for k in votes), r["count"]) for r in seen)
    if not patterns:
        good, accuracy = STARTS[0]
        return Model(good, [accuracy] * len(votes), [accuracy] * len(votes))
    found = [estimate(patterns, *start) for start in STARTS]
    return max(found, key=lambda x: x[0])[1]


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def judge(counted: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """counted with base_failed, posterior and kept."""
    base = base_failed()
    posterior = 1 / (1 + F.exp(-model.log_odds(rules())))
    return counted.select("*", base.alias("base_failed"), posterior.alias("posterior"), (~base & (posterior >= threshold)).alias("kept"))
