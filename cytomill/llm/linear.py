"""Hashed linear scorers: distributed term counts choose the features, a bounded sample fits the weights."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term function gives the terms (bytes) of a word; it must depend on the word alone, so that workers can remember it.
WordTerms = Callable[[bytes], Iterable[bytes]]
#: A splitter gives the distinct words of a text.
Split = Callable[[str], Iterable[bytes]]


class Terms(NamedTuple):
    """How a text becomes hashed terms: distinct words, then terms of each word, then buckets."""

    split: Split
    of_word: WordTerms
    bits: int = 18

    def buckets(self, wanted: Callable[[int], bool] | None = None, remember: int = 200_000) -> Callable[[str | None], set[int]]:
        """A function from text to its set of (wanted) buckets. It remembers up to `remember` words, then starts anew."""
        known: dict[bytes, tuple[int, ...]] = {}
        mask = (1 << self.bits) - 1

        def of(text: str | None) -> set[int]:
            out: set[int] = set()
            for word in self.split(text or ""):
                found = known.get(word)
                if found is None:
                    found = tuple(b for b in (zlib.crc32(t) & mask for t in self.of_word(word)) if wanted is None or wanted(b))
                    if len(known) >= remember:
                        known.clear()
                    known[word] = found
                if found:
                    out.update(found)
            return out

        return of


class LinearModel(NamedTuple):
    """Weights of hashed terms; every other bucket weighs nothing."""

    bias: float
    weights: dict[int, float]

    def score(self, buckets: set[int]) -> float:
        # sorted, so that the sum is the same wherever it runs
        z = self.bias + sum(self.weights.get(b, 0.0) for b in sorted(buckets))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def choose_buckets(sample: DataFrame, terms: Terms, most: int, text: str = "text", label: str = "label") -> list[int]:
    """The `most` buckets that tell the labels (0 to 1) apart best, by chi-squared over all sample rows.

    Each partition counts into fixed arrays of one slot per bucket, so what is shuffled is bounded by the bits.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pro, all_ = np.zeros(1 << terms.bits), np.zeros(1 << terms.bits)
        of = terms.buckets()
        for batch in batches:
            for t, y in zip(batch["t"], batch["y"], strict=True):
                at = np.fromiter(of(t), np.int64)
                pro[at] += y
                all_[at] += 1
        used = np.flatnonzero(all_)
        yield pd.DataFrame({"bucket": used, "pro": pro[used], "n": all_[used]})

    s = sample.select(F.col(text).alias("t"), F.col(label).cast("double").alias("y"))
    n, pro = s.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n or pro <= 0 or pro >= n:
        return []
    share = pro / n
    c = s.mapInPandas(count, "bucket long, pro double, n double").groupBy("bucket").agg(F.sum("pro").alias("pro"), F.sum("n").alias("n"))
    surprise = (F.col("pro") - F.col("n") * share) ** 2 / (F.col("n") * share * (1 - share)) * (n / (n - F.col("n") + 1))
    ranked = c.where("n >= 3").select("bucket", surprise.alias("chi")).orderBy(F.desc("chi"), "bucket").limit(most)
    return sorted(r["bucket"] for r in ranked.collect())


def design(sample: DataFrame, terms: Terms, chosen: list[int], text: str = "text", label: str = "label") -> tuple[list[np.ndarray], np.ndarray]:
    """Chosen bucket positions of every sample row, and the labels, in a fixed order."""
    place = {b: i for i, b in enumerate(chosen)}

    @F.pandas_udf("array<int>")
    def positions(texts: pd.Series) -> pd.Series:
        of = terms.buckets(place.__contains__)
        return pd.Series([sorted(place[b] for b in of(t)) for t in texts], dtype=object)

    rows = sample.select(positions(F.col(text)).alias("x"), F.col(label).cast("double").alias("y")).collect()
    rows.sort(key=lambda r: (r["y"], r["x"]))
    return [np.array(r["x"], np.int64) for r in rows], np.array([r["y"] for r in rows])


def fit(
    xs: list[np.ndarray], y: np.ndarray, chosen: list[int], pairs: list[tuple[np.ndarray, np.ndarray]] = (),
    l1: float = 2e-4, pair_weight: float = 1.0, rounds: int = 400, rate: float = 0.1,
) -> LinearModel:
    """Logistic regression on 0/1 terms, both classes weighing alike, with a lasso and squared score changes of `pairs` as penalties.

    Labels may be probabilities. Adam steps over all rows with a shrinking step after each (proximal lasso), a fixed number of rounds,
    no random numbers. Without rows of both classes the model has no weights and scores one half.
    """
    if not len(y) or not 0 < y.sum() < len(y) or not chosen:
        return LinearModel(0.0, {})
    k = len(chosen)
    row = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    col = np.concatenate(xs) if len(row) else np.zeros(0, np.int64)
    signs = [np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in pairs]
    p_row = np.repeat(np.arange(len(pairs)), [len(s) for s in signs]) if pairs else np.zeros(0, np.int64)
    p_col = np.concatenate([np.concatenate(p) for p in pairs]).astype(np.int64) if pairs else np.zeros(0, np.int64)
    p_sign = np.concatenate(signs) if pairs else np.zeros(0)
    weigh = 0.5 * (y / y.sum() + (1 - y) / (1 - y).sum())
    w, b = np.zeros(k), 0.0
    m1, m2 = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[col], len(y))
        miss = weigh * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.append(np.bincount(col, miss[row], k), miss.sum())
        if pairs:
            change = np.bincount(p_row, p_sign * w[p_col], len(pairs)) * (2 * pair_weight / len(pairs))
            g[:k] += np.bincount(p_col, p_sign * change[p_row], k)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:k], b - step[k]
        shrink = rate * l1 / (np.sqrt(m2[:k] / (1 - 0.999**t)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(shrink, rate), 0)
    return LinearModel(float(b), {chosen[i]: float(w[i]) for i in np.flatnonzero(w)})


def score(text: Column, terms: Terms, model: LinearModel) -> Column:
    """Score of each whole text, 0 to 1; null and empty texts have the bias alone."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = terms.buckets(model.weights.__contains__)
        for texts in batches:
            yield pd.Series([model.score(of(t)) for t in texts], dtype=float)

    return run.asNondeterministic()(text)
