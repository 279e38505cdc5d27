"""Benchmark decontamination: an FM-index over each training shard, searched backwards with the test phrases."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomill.llm.wordhash import settle

#: Word bytes are digits, letters (A-Z lower-cased) and everything beyond ASCII; all others separate words.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HITS = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Phrases:
    """Every window of the test items: `window` consecutive words, or the whole item if it is shorter."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            w = words_of(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                found[tuple(w[i : i + window])].add(item)
        #: word -> code from 1; 0 stands for every word that no phrase has
        self.codes = {w: i + 1 for i, w in enumerate(sorted({w for p in found for w in p}))}
        self.by_length: dict[int, tuple[np.ndarray, list[set[str]]]] = {}
        for m in sorted({len(p) for p in found}):
            same = sorted(p for p in found if len(p) == m)
            self.by_length[m] = np.array([[self.codes[w] for w in p] for p in same], np.int64), [found[p] for p in same]


class Bits:
    """A bit vector with ranks: packed words and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        raw = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([raw, np.zeros(8 + -len(raw) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0

    def ones(self, i: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)


class WaveletTree:
    """Ranks of symbols, one bit vector a level; each level keeps zeros before ones."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for shift in reversed(range(max(1, int(top).bit_length()))):
            bits = (symbols >> shift) & 1 == 1
            self.levels.append((shift, Bits(bits), len(bits) - int(bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each i."""
        start = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            a, b = bits.ones(start), bits.ones(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one, before = bits.get(i), bits.ones(i)
            out |= one.astype(np.int64) << shift
            i = np.where(one, zeros + before, i - before)
        return out


def suffix_order(keys: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling. The last key is smaller than all others."""
    n = len(keys)
    rank = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while rank[order[-1]] < n - 1:
        pair = rank * (n + 1)
        pair[: n - step] += rank[step:] + 1
        order = np.argsort(pair, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(pair[order]) != 0)])
        step *= 2
    return order


class FmIndex:
    """FM-index of word codes; code 0 separates segments and is never searched."""

    def __init__(self, codes: np.ndarray, top: int, every: int = 8):
        breaks = codes == 0
        n_breaks = int(breaks.sum())
        # distinct separators, later ones smaller: no comparison runs past a segment, and the last is the end mark
        keys = codes + n_breaks
        keys[breaks] = np.arange(n_breaks)[::-1]
        order = suffix_order(keys)
        before = codes[order - 1]  # the last code is a separator, so this also holds for position 0
        self.tree = WaveletTree(before, top)
        self.first = n_breaks + np.concatenate([[-n_breaks], np.cumsum(np.bincount(codes[~breaks], minlength=top + 2))])[: top + 2]
        known = (order % every == 0) | (before == 0)
        self.known, self.sampled = Bits(known), order[known]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high): the row interval of every phrase that occurs, from its last word to its first."""
        alive, last = np.arange(len(phrases)), phrases[:, -1]
        low, high = self.first[last], self.first[last + 1]
        for j in reversed(range(phrases.shape[1] - 1)):
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
            c = phrases[alive, j]
            low, high = self.first[c] + self.tree.rank(c, low), self.first[c] + self.tree.rank(c, high)
        keep = low < high
        return alive[keep], low[keep], high[keep]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk left until a sampled one; a segment's first position is always sampled."""
        out, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            at = self.known.get(rows)
            out[todo[at]] = self.sampled[self.known.ones(rows[at])] + steps
            todo, rows, steps = todo[~at], rows[~at], steps + 1
            c = self.tree.symbol(rows)
            rows = self.first[c] + self.tree.rank(c, rows)
        return out


def search_shard(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(words, disjoint word spans, items) of each text.

    Words outside the phrases separate; segments shorter than the shortest phrase can hold none and are left out of
    the index.
    """
    parts, n_words = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        w = words_of(text)
        n_words[i] = len(w)
        parts += [np.fromiter(map(phrases.codes.get, w, repeat(0)), np.int64, len(w)), np.zeros(1, np.int64)]
    out = [(int(n), [], []) for n in n_words]
    if not phrases.by_length or not texts:
        return out
    codes = np.concatenate(parts)
    origin = np.concatenate([[0], np.cumsum(n_words + 1)])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], codes > 0, [0]])))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= min(phrases.by_length)
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return out
    sizes = ends - starts + 1  # with the separator behind
    placed = np.concatenate([[0], np.cumsum(sizes)])
    source = np.repeat(starts - placed[:-1], sizes) + np.arange(placed[-1])
    index = FmIndex(codes[source], len(phrases.codes))
    spans, items = defaultdict(list), defaultdict(set)
    for m, (patterns, owners) in phrases.by_length.items():
        which, low, high = index.search(patterns)
        counts = high - low
        if not len(counts):
            continue
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        at = source[index.locate(rows)]
        doc = np.searchsorted(origin, at, "right") - 1
        for p, d, s in zip(np.repeat(which, counts).tolist(), doc.tolist(), (at - origin[doc]).tolist(), strict=True):
            spans[d].append((s, s + m))
            items[d] |= owners[p]
    for d, found in spans.items():
        found.sort()
        merged = [found[0]]
        for s, e in found[1:]:
            if s <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(e, merged[-1][1])
            else:
                merged.append((s, e))
        out[d] = int(n_words[d]), merged, sorted(i for i in items[d] if i is not None)
    return out


def _hits(phrases: Phrases, shard_chars: int):
    @F.pandas_udf(HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0

            def searched(texts: list[str | None]) -> pd.DataFrame:
                rows = search_shard(texts, phrases)
                return pd.DataFrame({
                    "n_words": [r[0] for r in rows], "spans": [[{"start": s, "end": e} for s, e in r[1]] for r in rows], "items": [r[2] for r in rows],
                })

            for text in batch:
                held.append(text)
                size += len(text or "")
                if size >= shard_chars:
                    yield searched(held)
                    held, size = [], 0
            if held:
                yield searched(held)

    return hits.asNondeterministic()  # so that no filter makes the plan run it twice


def phrase_blocks(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> Iterator[Phrases]:
    """The test phrases in blocks of about `block_bytes` of text; each is all that a task and the driver hold at a time."""
    b = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null")
    n = max(1, math.ceil((b.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    b = b.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    for k in range(n):
        yield Phrases([(r.item, r.text) for r in b.where(F.col("block") == k).collect()], window)


def _merged(spans: Column) -> Column:
    kind = "array<struct<start:int,end:int>>"
    return F.aggregate(
        F.array_sort(spans), F.array().cast(kind),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
        )).otherwise(F.concat(acc, F.array(s))),
    )


def with_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10,
    out: str = "hits", shard_chars: int = 4 << 20, block_bytes: int = 32 << 20,
) -> DataFrame:
    """`docs` with a struct column `out` (n_words, spans, items): disjoint word spans [start, end) that test phrases cover.

    A shard is as many consecutive texts as hold `shard_chars` characters; each is indexed and searched in memory, and no row
    is shuffled. Documents are scanned once per block of the benchmark, of which an ordinary one makes one; the hits of a block are
    written before the next is read, so no plan holds two.

    Null and empty texts have no words and no hits; items without words have no phrases; items without an id cover words
    but are not listed; an empty benchmark hits nothing. Repeated rows stay and agree; items that share a phrase are all listed. A column already named `out` is replaced.
    """
    found = docs
    names = []
    for phrases in phrase_blocks(benchmark, item, item_text, window, block_bytes):
        found = settle(found) if names else found
        names.append(f"__hits_{len(names)}")
        found = found.withColumn(names[-1], _hits(phrases, shard_chars)(F.col(text)))
    merged = F.struct(
        F.col(names[0])["n_words"].alias("n_words"),
        _merged(F.concat(*[F.col(c)["spans"] for c in names])).alias("spans"),
        F.array_sort(F.array_distinct(F.concat(*[F.col(c)["items"] for c in names]))).alias("items"),
    )
    return found.withColumn(out, merged).drop(*names)


def cut_spans(text: str, spans: list) -> str:
    """The text without the words of the spans and what stands between them."""
    # lower-casing A-Z changes no offset, so the original text is matched with both cases
    at = [m.span() for m in _WORD.finditer(text)]
    kept, last = [], 0
    for s in spans:
        kept.append(text[last : at[s["start"]][0]])
        last = at[s["end"] - 1][1]
    return "".join(kept) + text[last:]


def remove_hits(docs: DataFrame, text: str = "text", hits: str = "hits") -> DataFrame:
    """`docs` with the spans of `hits` cut out of the text; texts without hits do not leave the JVM.

    Null and empty texts stay as they are; very long texts are cut in one pass; repeated rows stay and agree; an empty table
    gives an empty result.
    """

    @F.pandas_udf("string")
    def without(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_spans(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    hit = F.size(F.col(hits)["spans"]) > 0
    return docs.withColumn(text, F.when(hit, without.asNondeterministic()(F.when(hit, F.col(text)), F.col(hits)["spans"])).otherwise(F.col(text)))
