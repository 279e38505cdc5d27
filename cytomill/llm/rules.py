"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long, n_exclaim long, n_stops long, n_plain long"
#: A word of letters with at most one mark of punctuation behind.
_PLAIN = re.compile(r"(?<!\S)[^\W\d_]+[,.;:?!]?(?!\S)")
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def repeat_words(words: Sequence[bytes]) -> int:
    """Words in three-word windows that the text has twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = np.unique(codes[:-1] * len(seen) + codes[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(seen) + codes[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of a text; words are separated by ASCII white space, null has none."""
    if not text:
        return (0,) * 11
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    letters = len(text) - sum(map(text.count, SPACES))
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = (raw >= 65) & (raw <= 90) | (raw >= 0xC0) & (raw <= 0xDE) & (raw != 0xD7)
    lower = (raw >= 97) & (raw <= 122) | (raw >= 0xDF) & (raw <= 0xFF) & (raw != 0xF7)
    n_upper = int(upper.sum())
    return (
        len(words), letters, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeat_words(words),
        n_upper, n_upper + int(lower.sum()), text.count("!"), text.count(".") + text.count("?") + text.count("!"),
        sum(1 for _ in _PLAIN.finditer(text)),
    )


def measures(text: Column) -> Column:
    """Struct column of MEASURES."""

    @F.pandas_udf(MEASURES)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=[m.split()[0] for m in MEASURES.split(", ")])

    return run.asNondeterministic()(text)


#: For rules that only vote against: no value is this low.
NEVER = -1.0


class Rule(NamedTuple):
    """Votes against quality where `value(measures)` is above `bad`, for it where it is at most `good`, abstains between."""

    name: str
    value: Callable[[Column], Column]
    good: float
    bad: float


RULES = (
    Rule("plain_words", lambda m: 1 - F.try_divide(m["n_plain"], m["n_words"]), 0.1, 0.3),
    Rule("symbols", lambda m: F.try_divide(m["n_symbols"], m["n_words"]), NEVER, 0.1),
    Rule("capitals", lambda m: m["n_upper"] / F.greatest(m["n_letters"], F.lit(1)), NEVER, 0.4),
    Rule("exclamations", lambda m: F.try_divide(m["n_exclaim"], m["n_words"]), NEVER, 0.1),
    Rule("repeated_words", lambda m: F.try_divide(m["n_repeat_words"], m["n_words"]), 0.1, 0.5),
    Rule("repeated_lines", lambda m: F.try_divide(m["n_dup_lines"], m["n_lines"]), NEVER, 0.5),
    Rule("word_length", lambda m: F.abs(F.try_divide(m["word_chars"], m["n_words"]) - 5.5), NEVER, 4.5),
    Rule("sentences", lambda m: m["n_words"] / (m["n_stops"] + 1), 30.0, 120.0),
)


def votes(m: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Array of -1 (against), 0 (abstains) or 1 (for) by rule; a text without words gets no votes."""
    some = m["n_words"] > 0
    return F.array(*[
        F.when(some & (r.value(m) > r.bad), F.lit(-1)).when(some & (r.value(m) <= r.good), F.lit(1)).otherwise(F.lit(0)) for r in rules
    ])


class VoteModel(NamedTuple):
    """Prior log-odds of quality and, by rule, the log-odds that a vote for and a vote against add."""

    prior: float
    pro: tuple[float, ...]
    contra: tuple[float, ...]

    def probability(self, vote: Column) -> Column:
        total = F.lit(self.prior)
        for i, (up, down) in enumerate(zip(self.pro, self.contra, strict=True)):
            total = total + F.when(vote[i] > 0, F.lit(up)).when(vote[i] < 0, F.lit(down)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def estimate(
    patterns: Sequence[tuple[Sequence[int], int]], n_rules: int, rounds: int = 500,
    good: float = 0.99, bad: float = 0.5, prior: float = 0.85,
    least_good: float = 0.98,
) -> VoteModel:
    """Expectation-maximisation over (votes, number of texts), from the given starting values.

    Each rule that votes is right with one accuracy on good texts and another on bad ones; abstaining says nothing. Rules are
    written to be wrong on few good texts, so the first accuracy stays at `least_good` or more: that keeps several unlike
    kinds of bad texts in one class, and the classes cannot swap. Each round adds ten texts of weight one at the starting
    accuracies, so rare votes keep finite odds; on bad texts a rule votes against at least as often as on good ones.
    Without patterns the starting values stand.
    """
    v = np.array([p for p, _ in patterns], float).reshape(len(patterns), n_rules)
    n = np.array([c for _, c in patterns], float)
    pro, contra = v > 0, v < 0
    right_good, right_bad = np.full(n_rules, good), np.full(n_rules, bad)
    odds = lambda: (np.log(right_good) - np.log1p(-right_bad), np.log1p(-right_good) - np.log(right_bad))
    for _ in range(rounds if len(n) else 0):
        up, down = odds()
        p = 1 / (1 + np.exp(-(np.log(prior) - np.log1p(-prior) + pro @ up + contra @ down)))
        w_good, w_bad = n * p, n * (1 - p)
        new_good = np.maximum((w_good @ pro + 10 * good) / (w_good @ (pro | contra) + 10), least_good)
        new_bad = np.maximum((w_bad @ contra + 10 * bad) / (w_bad @ (pro | contra) + 10), 1 - new_good)
        moved = max(np.abs(new_good - right_good).max(), np.abs(new_bad - right_bad).max())
        right_good, right_bad, prior = new_good, new_bad, float(np.clip(w_good.sum() / n.sum(), 0.05, 0.95))
        if moved < 1e-9:
            break
    up, down = odds()
    return VoteModel(float(np.log(prior) - np.log1p(-prior)), tuple(map(float, up)), tuple(map(float, down)))


def fit(measured: DataFrame, m: str = "measures", rules: Sequence[Rule] = RULES) -> VoteModel:
    """Estimates the model over all rows. Only the counts of vote patterns, at most 3 to the number of rules, reach the driver."""
    counts = measured.select(votes(F.col(m), rules).alias("votes")).groupBy("votes").count().orderBy("votes").collect()
    return estimate([(r["votes"], r["count"]) for r in counts], len(rules))


def base_failed(m: Column) -> Column:
    """Fixed conditions of the base rule: under 50 words, or more than half of the words repeat."""
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def judge(measured: DataFrame, model: VoteModel, m: str = "measures", out: str = "verdict", least: float = 0.5, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds struct `out` (base_failed, probability, kept); kept needs the base rule and a posterior of at least `least`.

    Null and empty texts and texts without words fail the base rule. Repeated rows agree. Columns named `out` are replaced.
    """
    failed = base_failed(F.col(m))
    p = model.probability(votes(F.col(m), rules))
    return measured.withColumn(out, F.struct(failed.alias("base_failed"), p.alias("probability"), (~failed & (p >= least)).alias("kept")))
