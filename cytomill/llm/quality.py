"""Quality scores learned from weak labels: heuristic labellers, their estimated accuracies, a hashed linear scorer."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomill.llm import linear, rules
from cytomill.session import cut

_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_CAPITALS = re.compile(rb"[A-Z]+")
_DIGITS = re.compile(rb"[0-9]+")


def shape(word: bytes) -> bytes:
    """Runs of small letters become a, of capitals A, of digits 0; marks stay."""
    return _DIGITS.sub(b"0", _CAPITALS.sub(b"A", _LETTERS.sub(b"a", word)))[:12]


def shape_shares(text: str) -> set[bytes]:
    """Each word shape with the power of two that its share of all words reaches, and how varied the words are."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return set()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    shapes: dict[bytes, int] = {}
    for w, n in counts.items():
        s = shape(w)
        shapes[s] = shapes.get(s, 0) + n
    out = {b"%s:%d" % (s, math.floor(math.log2(n / len(words)))) for s, n in shapes.items()}
    out.add(b"variety:%d" % math.floor(8 * len(counts) / len(words)))
    out.add(b"most:%d" % math.floor(math.log2(max(counts.values()) / len(words))))
    return out


def with_totals(word: bytes) -> list[bytes]:
    """The shape with its share, and the shape alone."""
    return [word, word.rpartition(b":")[0]]


TERMS = linear.Terms(shape_shares, with_totals)


def train(
    docs: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = 30_000, max_terms: int = 2048,
    labellers=rules.RULES, terms: linear.Terms = TERMS,
) -> tuple[DataFrame, rules.VoteModel, linear.LinearModel]:
    """(measures of all rows, labeller model, scorer).

    The labellers vote on all documents and expectation-maximisation over all votes gives the posterior quality of each; the scorer
    learns these posteriors from at most `max_rows` texts, those of the smallest text hashes. No given label is used.
    Null and empty texts get no votes and are not learned from. Without texts of both kinds every score is 0.5.
    """
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    measured = cut(d.select("key", F.xxhash64("text").alias("hash"), rules.measures(F.col("text")).alias("measures")))
    model = rules.fit(measured, rules=labellers)
    p = model.probability(rules.votes(F.col("measures"), labellers))
    ranked = measured.where("measures.n_words > 0").groupBy("hash").agg(F.max(p).alias("label"))
    picked = ranked.orderBy(F.xxhash64("hash"), "hash").limit(max_rows)
    # copies of one text have one hash and count once
    sample = d.where("text is not null").withColumn("hash", F.xxhash64("text")).join(F.broadcast(picked), "hash")
    sample = cut(sample.groupBy("hash").agg(F.first("text").alias("text"), F.first("label").alias("label")).select("text", "label"))
    chosen = linear.choose_buckets(sample, terms, max_terms)
    xs, ys = linear.design(sample, terms, chosen)
    return measured, model, linear.fit(xs, ys, chosen)


def score(text: Column, model: linear.LinearModel, terms: linear.Terms = TERMS) -> Column:
    """Quality of each whole text, 0 to 1. Null and empty texts get the score of a text without known terms."""
    return linear.score(text, terms, model)
