"""Exact substring deduplication: seed on winnowed anchors, extend where anchors repeat, keep the repeats that are long enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomill.llm.wordhash import BASES, WordHashes, settle, split_words, window_hashes

BLOCK_WORDS = 1 << 20


def anchor_of_windows(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """For each window of `length` words the start of its anchor, the leftmost of its `seed`-word grams with the least hash.

    The choice depends on the window's words alone, so equal windows have equal anchors at equal offsets.
    """
    grams = window_hashes(words, seed)
    span = length - seed + 1
    if len(grams) < span:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1)


def _blocks(words: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, words) of overlapping blocks that together hold each window once."""
    for at in range(0, max(0, len(words) - length + 1), BLOCK_WORDS):
        yield at, words[at : at + BLOCK_WORDS + length - 1]


def find_anchors(words: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every anchor of a text."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, block in _blocks(words, length):
        grams = window_hashes(block, seed)
        found = np.unique(anchor_of_windows(block, length, seed))
        hashes.append(grams[found])
        places.append(found + at)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first].view(np.int64), place


def find_windows(words: np.ndarray, anchors: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash, start) of the windows whose anchor is among the positions `anchors`."""
    out = []
    for at, block in _blocks(words, length):
        start = np.flatnonzero(np.isin(anchor_of_windows(block, length, seed) + at, anchors))
        second = window_hashes(block, length, BASES[1])[start] >> np.uint64(33)
        out.append((window_hashes(block, length)[start].view(np.int64), second.astype(np.int64), start + at))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _anchors(length: int, seed: int):
    @F.pandas_udf("n int, hashes array<long>, places array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for texts in batches:
            rows = []
            for t in texts:
                words = split_words(t)
                rows.append((len(words), *find_anchors(known.of(words), length, seed)))
            yield pd.DataFrame({"n": [r[0] for r in rows], "hashes": [r[1] for r in rows], "places": [r[2].astype(np.int32) for r in rows]})

    return run.asNondeterministic()


def _windows(length: int, seed: int):
    @F.pandas_udf("a array<long>, b array<int>, start array<int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for texts, places in batches:
            rows = [find_windows(known.of(split_words(t)), np.asarray(p, np.int64), length, seed) for t, p in zip(texts, places, strict=True)]
            yield pd.DataFrame({"a": [r[0] for r in rows], "b": [r[1].astype(np.int32) for r in rows], "start": [r[2].astype(np.int32) for r in rows]})

    return run.asNondeterministic()


def keep_rest(text: str | None, starts, whole: bool, length: int) -> tuple[int, int, str]:
    """(words, removed words, the other words joined by one space)."""
    words = split_words(text)
    if whole:
        return len(words), len(words), ""
    if starts is None or not len(starts):
        return len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass")
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.asarray(starts) + length, -1)
    covered = np.cumsum(edge)[:-1] > 0
    kept = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
    return len(words), int(covered.sum()), b" ".join(kept).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 35, seed: int = 20) -> DataFrame:
    """(key, n_words, n_removed, kept) for every row: without the words of windows of `length` words that start twice or more anywhere.

    1. Copies of a text are counted once, by SHA-256; of a text with copies, all windows repeat.
    2. Winnowing leaves about two anchors in `length - seed + 2` words, and every window has one. Joining the anchors that occur more than
       once back to their places gives the seeds.
    3. A seed is extended both ways by each window that has it as its anchor; two places match in such an extension if they agree on its words
       (95 bits of two hashes). Extensions are compared by key, never place with place, so a passage in a third of all documents
       costs as much as other passages. Overlapping matches make the maximal repeats.

    Anchors and windows are counted map-side; tables of what repeats are joined to their places as written tables, so adaptive
    execution splits hot ones. Null and empty texts and texts under `length` words lose nothing and null counts as empty. Repeated
    rows are copies of each other. Other columns are not read.
    """
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    texts = settle(
        d.withColumn("found", _anchors(length, seed)(F.col("text"))).groupBy("sha")
        .agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("found").alias("found"))
        .select("sha", F.col("key").alias("first_key"), "copies", "found.*", F.monotonically_increasing_id().alias("tid"))
    )
    places = texts.select("tid", F.explode(F.arrays_zip("hashes", "places")).alias("p")).select("tid", F.col("p.hashes").alias("anchor"), F.col("p.places").alias("place"))
    repeated = settle(places.groupBy("anchor").count().where("count > 1").select("anchor"))
    seeds = places.join(repeated, "anchor").groupBy("tid").agg(F.collect_list("place").alias("places"))
    seeded = settle(texts.select("sha", "first_key", "tid").join(seeds, "tid"))
    windows = settle(
        d.join(seeded, "sha").where(F.col("key").eqNullSafe(F.col("first_key")))
        .select("tid", _windows(length, seed)(F.col("text"), F.col("places")).alias("w")).select("tid", "w.*")
    )
    each = windows.select("tid", F.explode(F.arrays_zip("a", "b", "start")).alias("w")).select("tid", "w.*")
    # one place seen twice (a repeated row) is no repeat
    twice = each.groupBy("a", "b").agg(*[f(c).alias(f"{n}_{c}") for c in ("tid", "start") for n, f in (("min", F.min), ("max", F.max))])
    twice = settle(twice.where("min_tid < max_tid or min_start < max_start").select("a", "b"))
    starts = each.join(twice, ["a", "b"]).groupBy("tid").agg(F.collect_list("start").alias("starts"))
    cuts = texts.select("sha", "tid", ((F.col("copies") > 1) & (F.col("n") >= length)).alias("whole")).join(starts, "tid", "left")
    cuts = settle(cuts.where("whole or starts is not null").select("sha", "whole", F.when(~F.col("whole"), F.col("starts")).alias("starts")))

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def rest(text: pd.Series, starts: pd.Series, whole: pd.Series) -> pd.DataFrame:
        rows = [keep_rest(t, s, bool(w), length) for t, s, w in zip(text, starts, whole, strict=True)]
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    out = d.join(cuts, "sha", "left")
    run = rest.asNondeterministic()(F.col("text"), F.col("starts"), F.coalesce("whole", F.lit(False)))
    return out.select("key", run.alias("r")).select(F.col("key").alias(key), "r.*")
