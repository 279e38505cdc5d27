"""Near-duplicate classes: DartMinHash signatures, banded joining, exact similarity of the candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomill.llm.wordhash import WordHashes, mixed, settle, split_words, window_hashes
from cytomill.operators.graph import components

U = np.uint64
STREAMS = (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0xF1357AEA2E62A9C5)


def shingles(text: str | None, known: WordHashes, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of the k-word shingles of a text; a shorter text is one shingle, one without words has none."""
    words = known.of(split_words(text))
    if not len(words):
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.unique(window_hashes(words, min(k, len(words))), return_counts=True)


_POISSON: dict[int, np.ndarray] = {}


def _poisson(area: int) -> np.ndarray:
    """Cumulative Poisson probabilities for a region of this area; areas are powers of two, so few are ever asked for."""
    if area in _POISSON:
        return _POISSON[area]
    top = area + 12 * math.isqrt(area) + 24
    n = np.arange(top)
    logs = n * math.log(area) - area - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top)))])
    _POISSON[area] = np.cumsum(np.exp(logs))
    return _POISSON[area]


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def throw_darts(element: np.ndarray, weight: np.ndarray, limit: np.ndarray, coordinates: int, seed: int) -> tuple[np.ndarray, ...]:
    """(element index, coordinate, rank, id) of the darts that hit each element below its weight and its rank limit.

    Weight and rank are cut into regions whose sides double: weights [2^v - 1, 2^(v+1) - 1) by ranks [(2^r - 1) / 2^v, (2^(r+1) - 1) / 2^v), of
    area 2^r. The darts of a region come from the hash of element and region alone: their number is Poisson, their places
    are uniform. So equal elements see equal darts in all texts, however much of a region counts there.
    """
    out = []
    for v in range(int(math.floor(math.log2(float(weight.max(initial=0)) + 1))) + 1 if len(weight) else 0):
        heavy = np.flatnonzero(weight > 2**v - 1)
        r = 0
        while len(heavy := heavy[limit[heavy] > (2**r - 1) / 2**v]):
            region = mixed(element[heavy] ^ mixed(np.full(1, (seed << 16) + (v << 8) + r, U) * U(STREAMS[3])))
            darts = np.searchsorted(_poisson(2**r), _unit(mixed(region ^ U(STREAMS[2]))), "right")
            at = np.repeat(heavy, darts)
            number = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mixed(np.repeat(region, darts) + (number.astype(U) + U(1)) * U(STREAMS[0]))
            rank = (2**r - 1 + _unit(mixed(dart ^ U(STREAMS[1]))) * 2**r) / 2**v
            high = 2**v - 1 + _unit(mixed(dart ^ U(STREAMS[2]))) * 2**v
            hit = (rank <= limit[at]) & (high < weight[at])
            dart = dart[hit]
            out.append((at[hit], (_unit(mixed(dart ^ U(STREAMS[3]))) * coordinates).astype(np.int64), rank[hit], dart))
            r += 1
    return tuple(np.concatenate(p) for p in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], coordinates: int, seed: int = 1) -> np.ndarray:
    """For each weighted set the id of the earliest dart of each coordinate; two agree with the sets' weighted Jaccard similarity.

    The rank limit lets about `coordinates` x (ln `coordinates` + 4) darts through; sets with an empty coordinate throw again
    with twice the limit, which adds later darts only. Sets without elements have zeros.
    """
    sizes = np.array([len(h) for h, _ in texts], np.int64)
    total = np.array([c.sum() for _, c in texts], float)
    sign = np.zeros((len(texts), coordinates), U)
    todo, limit = np.flatnonzero(sizes > 0), coordinates * (math.log(coordinates) + 4) / np.maximum(total, 1)
    while len(todo):
        owner = np.repeat(todo, sizes[todo])
        element = np.concatenate([texts[i][0] for i in todo])
        weight = np.concatenate([texts[i][1] for i in todo]).astype(float)
        at, coordinate, rank, dart = throw_darts(element, weight, limit[owner], coordinates, seed)
        order = np.argsort(-rank, kind="stable")  # the last write of a slot, its earliest dart, stays
        filled = np.zeros((len(texts), coordinates), bool)
        slot = owner[at][order], coordinate[order]
        sign[slot], filled[slot] = dart[order], True
        todo = todo[~filled[todo].all(axis=1)]
        limit[todo] *= 2
    return sign


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sign), bands), U)
    for j in range(rows):
        out = mixed(out + sign[:, j::rows] * U(STREAMS[0]))
    return out.view(np.int64)


#: Bits of each coordinate that the planes keep, and standard deviations that an estimate may fall short.
PLANES, SLACK = 2, 4.0


def planes(sign: np.ndarray) -> np.ndarray:
    """The lowest bits of every coordinate as bit planes: (texts, PLANES x words) 64-bit numbers, plane by plane."""
    n, coordinates = sign.shape
    words = -(-coordinates // 64)
    bits = np.zeros((n, PLANES, words * 64), bool)
    for k in range(PLANES):
        bits[:, k, :coordinates] = (sign >> U(k)) & U(1)
    return np.packbits(bits, axis=2, bitorder="little").view("<i8").reshape(n, PLANES * words)


def differing(a: str, b: str, coordinates: int) -> Column:
    """How many coordinates of two plane columns differ in any plane."""
    words = -(-coordinates // 64)
    total = F.lit(0)
    for w in range(words):
        apart = [F.col(a)[k * words + w].bitwiseXOR(F.col(b)[k * words + w]) for k in range(PLANES)]
        total = total + F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), apart))
    return total


def most_differing(least: float, coordinates: int) -> float:
    """So many coordinates of a pair at similarity `least` differ at most, but for a chance of 3e-5: coordinates agree with the
    similarity, and otherwise in all planes by chance."""
    chance = 0.5**PLANES
    p = (1 - chance) * (1 - least)
    return coordinates * p + SLACK * math.sqrt(coordinates * p * (1 - p))


#: Bits of the parity sketch.
ODD = 512


def odd_sketch(element: np.ndarray, count: np.ndarray) -> np.ndarray:
    """ODD bits as 64-bit numbers: a bit is set if an odd number of the shingles, each copy counted on its own, falls on it."""
    copy = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    slot = mixed(np.repeat(element, count) + copy.astype(U) * U(STREAMS[1])) & U(ODD - 1)
    odd = np.bincount(slot.astype(np.int64), minlength=ODD) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def may_reach(least: float, a: str = "_a", b: str = "_b") -> Column:
    """Whether the columns n and odd of two texts allow the similarity; never false for a pair that has it.

    Each shingle that only one of the texts holds flips one bit, so at least as many shingles differ as bits do, and a pair at
    similarity s differs in (n_a + n_b) (1 - s) / (1 + s) of them.
    """
    n = F.col(f"n{a}") + F.col(f"n{b}")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"odd{a}")[w].bitwiseXOR(F.col(f"odd{b}")[w])) for w in range(ODD // 64)])
    return (F.least(f"n{a}", f"n{b}") >= least * F.greatest(f"n{a}", f"n{b}") - 1e-9) & (apart * (1 + least) <= n * (1 - least) + 1e-9)


def _sketch(bands: int, rows: int, shingle: int, darts: int = 400_000):
    @F.pandas_udf("n long, keys array<long>, planes array<long>, odd array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordHashes(150_000)
        each = int(bands * rows * (math.log(bands * rows) + 4))  # darts that a text throws at least

        def sketched(held: list) -> pd.DataFrame:
            sign = signatures(held, bands * rows)
            keys, bits = list(band_keys(sign, bands, rows)), list(planes(sign))
            odd = [odd_sketch(h, c) for h, c in held]
            return pd.DataFrame({
                "n": [int(c.sum()) for _, c in held], "keys": pd.Series(keys, dtype=object), "planes": pd.Series(bits, dtype=object),
                "odd": pd.Series(odd, dtype=object),
            })

        for texts in batches:  # handed back in parts, so that the darts of a batch need not stand in memory together
            held, size = [], 0
            for t in texts:
                held.append(shingles(t, known, shingle))
                size += len(held[-1][0]) + each
                if size >= darts:
                    yield sketched(held)
                    held, size = [], 0
            if held:
                yield sketched(held)

    return run.asNondeterministic()


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: common count over joint count; 0 if a side is empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    joint = int(a[1].sum() + b[1].sum()) - common
    return common / joint if joint else 0.0


def _similar(shingle: int):
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = WordHashes(150_000)
        for left, right in batches:
            out, last, held = [], None, None
            for a, b in zip(left, right, strict=True):
                if a != last:
                    last, held = a, shingles(a, known, shingle)
                out.append(similarity(held, shingles(b, known, shingle)))
                if len(out) == 256:
                    yield pd.Series(out, dtype=float)
                    out = []
            if out:
                yield pd.Series(out, dtype=float)

    return run.asNondeterministic()


def _large(df: DataFrame) -> DataFrame:
    """A side that grows with the documents: merged at every size, never broadcast."""
    return df.hint("merge")


def _scored(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b, s): the pairs with the similarity of their texts; of several texts of a node the most similar count."""
    both = pairs.join(_large(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))), "a").join(
        _large(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))), "b"
    )
    return settle(both.select("a", "b", _similar(shingle)(F.col("text_a"), F.col("text_b")).alias("s")).groupBy("a", "b").agg(F.max("s").alias("s")))


def classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, bands: int = 40, rows: int = 6, shingle: int = 5,
    whole_rows: bool = False,
) -> DataFrame:
    """(key, class_id, sha) for every row of `docs`; class_id is the smallest key of its class, sha the SHA-256 of the text.

    With `whole_rows` a struct `row` of all columns of `docs` comes along (and the texts are shuffled once more).

    Classes are the connected components of "weighted Jaccard similarity of shingle counts is at least `least`". With 40 bands of 6
    a pair at 0.8 is missed with probability 5e-6, one at 0.85 with 1e-8.

    1. Copies of a text become one node, named by their smallest key, and only nodes are banded.
    2. In each bucket every node whose parity sketch allows the similarity is compared with the bucket's most central node, and
       similar ones are linked. The sketch bounds the number of differing shingles from below, so it loses no pair.
    3. In buckets that then still hold nodes of several components, nodes of different components are compared if they meet in two
       such buckets (a pair at 0.8 misses that with probability 8e-5), their sizes and parity sketches allow the similarity, so do
       their distances from the bucket's central node where known (one minus the similarity is a metric), and two bits of each of the 240 coordinates agree
       as often as those of a pair at 0.8 do (missed with probability 3e-5). So members of one class cost one comparison a
       bucket; nodes that resemble a large class without belonging to it are compared with the few members that pass all bounds.
    Each comparison is exact, on whole texts. Keys may be numbers or strings. Joins read written tables, so adaptive execution splits buckets and texts with many pairs.

    Null texts and texts without words have no copies: class_id is their own key. Rows without a key take the class of
    an equal text with a key, else null. Rows that share a key are one document, whatever their texts. Any
    columns are allowed; an empty table gives an empty result.
    """
    row = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if whole_rows else []
    packed = docs.select(*row, F.col(key).alias("key"), F.col(text).alias("text"))
    packed = packed.withColumn("sha", F.unhex(F.sha2("text", 256)))
    nodes = settle(
        packed.select("key", "sha", _sketch(bands, rows, shingle)(F.col("text")).alias("s")).where("s.n > 0")
        .groupBy("sha").agg(F.min("key").alias("node"), F.first("s.n").alias("n"), F.first("s.keys").alias("keys"), F.first("s.planes").alias("planes"), F.first("s.odd").alias("odd"))
        .where("node is not null")
    )
    banded = nodes.select("node", "n", F.posexplode("keys").alias("band", "bucket"))
    shared = settle(banded.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = settle(banded.join(_large(shared), ["band", "bucket"]))  # rows of the few buckets that hold more than one node
    # the node that meets most others over all its buckets lies nearest to the middle of its group
    met = settle(members.groupBy("node").agg(F.sum("size").alias("met")))
    members = members.join(_large(met), "node")
    most = members.groupBy("band", "bucket").agg(F.max("met").alias("met"))
    leaders = settle(members.join(_large(most), ["band", "bucket", "met"]).groupBy("band", "bucket").agg(F.min("node").alias("leader")))
    members = settle(members.drop("size", "met").join(_large(leaders), ["band", "bucket"]))
    involved = nodes.join(_large(members.select("node").distinct()), "node").select("sha", "node")
    # the text of a node is taken from the row that names it
    texts = settle(packed.join(_large(settle(involved)), "sha").where("key = node").select("node", "text"))

    pairs = members.where("leader <> node").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    sides = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}")) for x in "ab"]
    pairs = pairs.distinct().join(_large(sides[0]), "a").join(_large(sides[1]), "b")
    pairs = settle(pairs.where(may_reach(least)).select("a", "b"))
    scored = _scored(pairs, texts, shingle)
    near = scored.where(F.col("s") >= least).select("a", "b")
    so_far = settle(components(near, None, "a", "b"))
    placed = members.join(_large(so_far), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = placed.withColumn("a", F.least("leader", "node")).withColumn("b", F.greatest("leader", "node")).join(_large(scored), ["a", "b"], "left")
    placed = settle(placed.select("band", "bucket", "node", "n", "component", F.when(F.col("leader") == F.col("node"), 1.0).otherwise(F.col("s")).alias("s")))
    mixed_buckets = placed.groupBy("band", "bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_ = settle(placed.join(_large(settle(mixed_buckets.select("band", "bucket"))), ["band", "bucket"]))
    own = open_.groupBy("node").agg(F.sort_array(F.collect_list(F.xxhash64("band", "bucket"))).alias("own"))  # one per band at most
    held = open_.join(_large(own.where(F.size("own") > 1)), "node").join(_large(nodes.select("node", "planes", "odd")), "node")
    held = settle(held)
    left, right = (held.select("band", "bucket", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "component", "s", "own", "planes", "odd")]) for side in "ab")
    common = F.array_intersect("own_a", "own_b")
    alike = (
        (F.col("component_a") != F.col("component_b")) & (F.col("node_a") < F.col("node_b"))
        & F.coalesce(F.abs(F.col("s_a") - F.col("s_b")) <= 1 - least + 1e-9, F.lit(True))
        & (differing("planes_a", "planes_b", bands * rows) <= most_differing(least, bands * rows))
        & may_reach(least)
        & (F.size(common) > 1) & (F.element_at(common, 1) == F.xxhash64(F.col("l.band"), F.col("l.bucket")))  # each pair once
    )
    # the bounds belong to the join, so pairs that fail them are never handed on
    met_there = (F.col("l.band") == F.col("r.band")) & (F.col("l.bucket") == F.col("r.bucket"))
    across = left.alias("l").join(_large(right.alias("r")), met_there & alike).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    across = settle(across.join(_large(pairs), ["a", "b"], "left_anti"))
    far = _scored(across, texts, shingle).where(F.col("s") >= least).select("a", "b")
    final = settle(components(near.unionByName(far), None, "a", "b")) if far.take(1) else so_far

    named = settle(nodes.select("sha", "node").join(_large(final), "node", "left").select("sha", F.coalesce("component", "node").alias("class_id")))
    carried = ["row"] if whole_rows else []
    out = packed.drop("text").join(_large(named), "sha", "left")
    return out.select("key", F.coalesce("class_id", "key").alias("class_id"), "sha", *carried)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, the one with the smallest key, in the columns of `docs`.

    Of repeated rows (same key and text) one stays; of rows that share a key but not the text, each text stays once. A row
    without a key stays, once per text, if no row with a key has its text.
    """
    c = classes(docs, key, text, whole_rows=True)
    return c.where(F.col("key").eqNullSafe(F.col("class_id"))).dropDuplicates(["key", "sha"]).select("row.*")
