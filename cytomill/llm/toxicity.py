"""Toxicity scores from a counterfactually regularised classifier."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomill.llm import linear
from cytomill.llm.decontaminate import words_of
from cytomill.session import cut

#: Words that name groups of people without judging them. Words of one line stand for each other.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"), ("queer", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("african", "european", "american", "mexican", "indian", "chinese"),
    ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"), ("deaf", "blind", "disabled"), ("old", "young", "elderly"),
)
_NEXT = {w.encode(): group[(i + 1) % len(group)].encode() for group in IDENTITY_GROUPS for i, w in enumerate(group)}
_SENTENCE = re.compile(r"[.!?\n]+")


def distinct_words(text: str) -> set[bytes]:
    return set(words_of(text))


def word_terms(word: bytes) -> list[bytes]:
    """The word, and its beginnings of 4 to 6 bytes for inflected languages."""
    return [word, *(b"^" + word[:n] for n in (4, 5, 6) if len(word) > n)]


TERMS = linear.Terms(distinct_words, word_terms)


def swapped_sentences(text: str | None) -> Iterator[tuple[set[bytes], set[bytes]]]:
    """(words, words with identity terms exchanged) of every sentence that has such terms."""
    for sentence in _SENTENCE.split(text or ""):
        words = set(words_of(sentence))
        if not words.isdisjoint(_NEXT):
            yield words, {_NEXT.get(w, w) for w in words}


def _pairs(sample: DataFrame, terms: linear.Terms, chosen: list[int], most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Term positions of at most `most` different swapped sentences that change; what both sides share cancels and is left out."""
    place = {b: i for i, b in enumerate(chosen)}

    def changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = linear.Terms(lambda words: words, terms.of_word, terms.bits)
        of = plain.buckets(place.__contains__)
        for batch in batches:
            out = set()
            for text in batch["text"]:
                for a, b in swapped_sentences(text):
                    x, y = of(a), of(b)
                    if x != y:
                        out.add((tuple(sorted(place[i] for i in x - y)), tuple(sorted(place[i] for i in y - x))))
            yield pd.DataFrame({c: pd.Series([list(p[i]) for p in sorted(out)], dtype=object) for i, c in enumerate("ab")})

    found = sample.select("text").mapInPandas(changes, "a array<int>, b array<int>").distinct().orderBy(F.xxhash64("a", "b"), "a", "b").limit(most)
    return [(np.array(r["a"], np.int64), np.array(r["b"], np.int64)) for r in found.collect()]


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
    max_rows: int = 30_000, max_terms: int = 4096, max_pairs: int = 20_000, pair_weight: float = 1.0, terms: linear.Terms = TERMS,
) -> linear.LinearModel:
    """Fits the classifier on at most `max_rows` labelled documents (those of the smallest key hashes) for which `usable` (over labels) holds.

    For each sentence with identity terms the terms are exchanged within their group, and the squared change of the score is
    a penalty, so neutral mentions of one group score as those of another. Only the sample's keys are broadcast.
    Null keys, labels and texts are left out; a key labelled twice has its largest label. Without rows of both labels every score is 0.5.
    """
    y = labels.where(usable).where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    y = y.orderBy(F.xxhash64("key"), "key").limit(max_rows)
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    sample = cut(d.join(F.broadcast(y), "key").select("text", "label"))
    chosen = linear.choose_buckets(sample, terms, max_terms)
    xs, ys = linear.design(sample, terms, chosen)
    return linear.fit(xs, ys, chosen, _pairs(sample, terms, chosen, max_pairs), pair_weight=pair_weight)


def score(text: Column, model: linear.LinearModel, terms: linear.Terms = TERMS) -> Column:
    """Toxicity of each whole text, 0 to 1. Null and empty texts get the score of a text without known terms."""
    return linear.score(text, terms, model)
