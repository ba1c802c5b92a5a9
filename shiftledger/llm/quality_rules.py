"""Quality rules by weak supervision: rules vote or abstain, and their agreement says how far each can be trusted.

Every rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of vote patterns (at
most 3 ** rules of them, whatever the input) estimates how accurate the bad and the good votes of each rule are. A document is kept when its posterior probability of being good is at least one half. DataFrame functions only.

Rows: a null text has no words; equal rows get equal results; other columns are not read. Without rows nothing is
kept or dropped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import let, words

REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Fixed value: the characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]"


def repeated_words(w: Column, size: int = REPEAT_WINDOW) -> Column:
    """Words covered by windows of `size` words that occur twice or more in the array `w`, all occurrences included."""
    none = F.expr("cast(array() as array<bigint>)")
    hashes = F.when(F.size(w) > size,
                    F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))
                    ).otherwise(none)

    def covered(places: Column) -> Column:
        step = lambda p, k: F.coalesce(F.least(F.get(places, k + 1) - p, F.lit(size)), F.lit(size))
        return F.aggregate(F.transform(places, step), F.lit(0).cast("long"), lambda acc, x: acc + x)

    def pairs(s: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        twice = F.filter(s, lambda e, k: same(e, F.get(s, k - 1)) | same(e, F.get(s, k + 1)))
        return let(F.sort_array(F.transform(twice, lambda e: e["i"])), covered)

    def count(h: Column) -> Column:
        entries = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(entries), pairs))

    return let(hashes, count)


def features(text: Column) -> Column:
    """What the rules look at, as one struct."""
    text = F.coalesce(text, F.lit(""))

    def lines(kept: Column) -> Column:
        return F.struct(F.size(kept).cast("long").alias("n"), (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("dup"))

    def of(w: Column) -> Column:
        chars = F.length(F.array_join(w, "")).cast("long")
        return F.struct(
            F.size(w).cast("long").alias("n_words"), chars.alias("word_chars"), repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))).alias("n_stuck"))

    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return F.struct(
        let(words(text), of).alias("words"), let(full, lines).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[.!?]")).cast("long").alias("n_marks"),
        F.regexp_count(text, F.lit("[A-ZÀ-ÖØ-Þ]")).cast("long").alias("n_upper"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


@dataclass(frozen=True)
class Rule:
    """Votes bad beyond one bound, good within another, and abstains between them."""

    name: str
    bad: Column
    good: Column

    def vote(self) -> Column:
        return F.when(self.bad, -1).when(self.good, 1).otherwise(0)


def rules(f: Column) -> list[Rule]:
    n, chars = f["words"]["n_words"], f["words"]["word_chars"]
    some = F.greatest(n, F.lit(1))
    repeat, mean = f["words"]["n_repeat_words"] / some, chars / some
    symbols = f["n_symbols"] / F.greatest(chars, F.lit(1))
    dup, marks, upper = f["lines"]["dup"] / F.greatest(f["lines"]["n"], F.lit(1)), f["n_marks"] / some, f["n_upper"] / some
    return [
        Rule("length", n < MIN_WORDS, n >= 50),
        Rule("repeats", repeat > 0.3, repeat < 0.1),
        Rule("word_length", (mean < 2.5) | (mean > 12), (mean >= 3.5) & (mean <= 9)),
        Rule("stuck_words", f["words"]["n_stuck"] / some > 0.2, f["words"]["n_stuck"] / some < 0.05),
        Rule("symbols", symbols > 0.05, symbols < 0.02),
        Rule("duplicate_lines", dup > 0.5, dup < 0.3),
        Rule("sentence_marks", marks > 0.8, marks <= 0.4),
        Rule("capitals", upper > 1.5, upper < 0.7),
    ]


def votes(f: Column) -> Column:
    """The votes of all rules, as an array of -1, 0 and 1."""
    return F.array(*[r.vote() for r in rules(f)])


#: Rules are taken to be better than chance: of the bad votes of a rule at least this share is right, of its good votes
#: at least the share of good documents, and no more documents are bad than some rule votes bad on.
LEAST_ACCURACY, MOST_ACCURACY = 0.9, 0.999
SMOOTHING = 20  # votes at the least accuracy that are added to those of each rule


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


@dataclass(frozen=True)
class Model:
    """Share of good documents, and for each rule the accuracy of its bad and of its good votes.

    A vote moves the log odds from the prior by its accuracy; an abstention says nothing.
    """

    prior: float
    accuracy: tuple[tuple[float, float], ...]

    def weights(self) -> list[tuple[float, float]]:
        prior = _logit(self.prior)
        return [(-_logit(bad) - prior, _logit(good) - prior) for bad, good in self.accuracy]

    def log_odds(self, pattern) -> float:
        return _logit(self.prior) + sum(bad if v < 0 else good for v, (bad, good) in zip(pattern, self.weights()) if v)

    def posterior(self, v: Column) -> Column:
        """Probability of good for an array of votes."""
        odds = F.lit(_logit(self.prior))
        for j, (bad, good) in enumerate(self.weights()):
            odds = odds + F.when(v[j] < 0, bad).when(v[j] > 0, good).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> Model:
    """Expectation-maximisation over counted vote patterns, from: a pattern with a bad vote is probably bad."""
    n_rules = len(next(iter(patterns), ()))
    total = sum(patterns.values())
    unblamed = sum(n for p, n in patterns.items() if min(p, default=0) >= 0)
    bounded = lambda p, low: min(MOST_ACCURACY, max(low, p))
    good = {p: 0.1 if min(p, default=0) < 0 else 0.9 for p in patterns}
    model = Model(0.5, ((LEAST_ACCURACY,) * 2,) * n_rules)
    for _ in range(rounds):
        share = (sum(good[p] * n for p, n in patterns.items()) + 1) / (total + 2)
        prior = bounded(share, max(1 - MOST_ACCURACY, unblamed / total if total else 0.5))
        accuracy = []
        for j in range(n_rules):
            each = []
            for vote, low in ((-1, max(LEAST_ACCURACY, 1 - prior)), (1, prior)):
                voted = [(n, good[p] if vote > 0 else 1 - good[p]) for p, n in patterns.items() if p[j] == vote]
                right = (sum(n * q for n, q in voted) + SMOOTHING * low) / (sum(n for n, _ in voted) + SMOOTHING)
                each.append(bounded(right, low))
            accuracy.append(tuple(each))
        new = Model(prior, tuple(accuracy))
        good = {p: 1 / (1 + math.exp(-new.log_odds(p))) for p in patterns}
        if abs(new.prior - model.prior) < 1e-9:
            return new
        model = new
    return model


def learn(voted: DataFrame, column: str = "votes") -> Model:
    """The model of all rows of `voted`; one aggregation, whose result has at most 3 ** rules rows."""
    counted = voted.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()
    return fit({tuple(r[0]): r["n"] for r in counted})
