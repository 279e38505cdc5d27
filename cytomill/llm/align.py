"""Alignment of two tokenizers by byte offsets, and corpus counts of aligned id pairs behind a minimal perfect hash."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomill.llm import bpe
from cytomill.llm.wordhash import mixed
from cytomill.session import cut

#: A text is cut before spaces that follow other characters and come before one; no token of either tokenizer runs over such a cut.
CUT = re.compile(r"(?<=\S)(?= +[^ ])")
#: Keys a hash shard holds on average, keys with counts that workers may hold as a broadcast (about 20 bytes each), fan-in of the tree.
SHARD, MOST_SHARED, FAN = 1 << 18, 4_000_000, 8
B_IDS = 1 << 20


class Tokenizers(NamedTuple):
    """Both tokenizers as the driver read them: rank tables for plain chunks, whole files for the rest, and bytes of all ids."""

    a_file: str
    a_ranks: bpe.Ranks
    a_bytes: list[bytes]
    b_model: bytes
    b_ranks: bpe.Ranks
    b_bytes: list[bytes]
    b_missing: frozenset[str]


def read_tokenizers(a_file: str, b_file: str) -> Tokenizers:
    """A byte-level BPE file (A) and a SentencePiece BPE model with byte fallback (B) that puts a space before each text."""
    import sentencepiece
    from tokenizers import Tokenizer

    with open(a_file, encoding="utf-8") as f:
        a_text = f.read()
    with open(b_file, "rb") as f:
        b_model = f.read()
    letters, a = bpe.byte_letters(), Tokenizer.from_str(a_text)
    named = {i: t for t, i in a.get_vocab(with_added_tokens=True).items()}
    a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in (named.get(i, "") for i in range(max(named) + 1))]
    b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
    missing = frozenset(c for c in map(chr, range(0x80, 0x130)) if b.piece_to_id(c) == b.unk_id())
    b_ranks, b_bytes = bpe.ranks_of_pieces(b_file)
    if len(b_bytes) > B_IDS:
        raise ValueError("too many piece ids")
    return Tokenizers(a_text, bpe.ranks_of_merges(a_file), a_bytes, b_model, b_ranks, b_bytes, missing)


class Aligned(NamedTuple):
    """Distinct chunks of some texts with their tokens, groups and links, and the chunk numbers of each text in order.

    `links` are packed as a * B_IDS + b, which is exact; those of chunk c stand from link_start[c] to link_start[c + 1].
    """

    number: np.ndarray
    per_text: np.ndarray
    fits: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    links: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray
    link_start: np.ndarray

    def text_sums(self, of_chunk: np.ndarray) -> np.ndarray:
        """Sum per text of an exact whole number per chunk."""
        run = np.concatenate([[0], np.cumsum(of_chunk[self.number])])
        ends = np.cumsum(self.per_text)
        return run[ends] - run[ends - self.per_text]

    def text_fits(self) -> np.ndarray:
        """Whether both token sequences of a text spell it. An empty text has no chunks and no tokens."""
        return self.text_sums((~self.fits).astype(np.int64)) == 0

    def group_texts(self) -> pa.Array:
        """"a1,a2|b1;a3|b2" of each chunk."""
        def side(ids: np.ndarray, last: np.ndarray) -> pa.Array:
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last + 1]), pa.int32()), pa.array(ids).cast(pa.string())), ",")

        groups = pc.binary_join_element_wise(side(self.a, self.at_a), side(self.b, self.at_b), "|")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(self.link_start, pa.int32()), groups), ";")


class Aligner:
    """Aligns batches of texts in a worker."""

    def __init__(self, t: Tokenizers):
        import sentencepiece
        from tokenizers import Tokenizer

        self.t = t
        self.a_encode, self.b_encode = t.a_ranks.encoder(), bpe.Ranks(t.b_ranks.table, {}, "(?s) *[^ ]+| +").encoder()
        self.a_library = Tokenizer.from_str(t.a_file)
        self.a_library.encode_special_tokens = True
        self.b_library = sentencepiece.SentencePieceProcessor(model_proto=t.b_model)
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (t.a_bytes, t.b_bytes))

    def batches(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, Aligned]]:
        """(row numbers, alignment) of all rows, first those whose chunks are plain splits at spaces, then the others."""
        words = pc.split_pattern(pc.fill_null(texts, ""), " ")
        words = words.filter(pa.array(np.ones(len(words), bool)))
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        counts[pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) == 0] = 0
        coded = words.flatten()
        if len(coded) != counts.sum():  # the empty word of an empty text
            coded = coded.filter(pa.array(np.repeat(counts > 0, pc.list_value_length(words).to_numpy(zero_copy_only=False))))
        coded = coded.dictionary_encode()
        chunks, number = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        open_end = np.fromiter((not w or w[-1].isspace() for w in chunks), bool, len(chunks))
        owner = np.repeat(np.arange(len(counts)), counts)
        hard = np.zeros(len(counts), bool)
        hard[owner[open_end[number]]] = True
        easy = np.flatnonzero(~hard)
        kept = number[~hard[owner]]
        used, dense = np.unique(kept, return_inverse=True)
        yield easy, self._aligned([chunks[i] for i in used], dense, counts[easy])
        if hard.any():
            rest = np.flatnonzero(hard)
            known: dict[str, int] = {}
            found = [[known.setdefault(c[1:], len(known)) for c in CUT.split(" " + t)] for t in texts.take(pa.array(rest)).to_pylist()]
            yield rest, self._aligned(list(known), np.array([i for f in found for i in f], np.int64), np.array([len(f) for f in found], np.int64))

    def _tokens(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """(A ids in a row, per chunk, B ids in a row, per chunk, whether they spell the chunk); each chunk stands behind a space."""
        joined = " ".join(chunks)
        if chunks and bpe.PLAIN.fullmatch(joined) and self.t.b_missing.isdisjoint(joined) and not any(not c or c[-1].isspace() for c in chunks):
            ends = np.cumsum([len(c) + 1 for c in chunks] if joined.isascii() else [len(c.encode()) + 1 for c in chunks])
            out = []
            for encode, ranks, size in ((self.a_encode, self.t.a_ranks, self.a_size), (self.b_encode, self.t.b_ranks, self.b_size)):
                ids = ranks.ids[np.array(encode(" " + joined), np.int64)]
                upto = np.searchsorted(np.cumsum(size[ids]), ends, "right")
                out += [ids, np.diff(upto, prepend=0)]
            return *out, np.ones(len(chunks), bool)
        plain = np.fromiter((bool(c) and not c[-1].isspace() and bpe.plain_of_pieces(c, self.t.b_missing) for c in chunks), bool, len(chunks))
        if plain.any():
            parts = [self._tokens([c for c, p in zip(chunks, plain, strict=True) if p])]
            odd = [c for c, p in zip(chunks, plain, strict=True) if not p]
        else:
            parts, odd = [], chunks
        a = [e.ids for e in self.a_library.encode_batch([" " + c for c in odd], add_special_tokens=False)]
        b = [self.b_library.encode(c) for c in odd]
        fits = [
            b"".join(map(self.t.a_bytes.__getitem__, x)) == (s := (" " + c).encode()) == b"".join(map(self.t.b_bytes.__getitem__, y))
            for c, x, y in zip(odd, a, b, strict=True)
        ]
        a, b = ([x if f else [] for x, f in zip(side, fits, strict=True)] for side in (a, b))
        own = [np.array(v, np.int64) for v in ([i for x in a for i in x], [len(x) for x in a], [i for x in b for i in x], [len(x) for x in b])]
        parts.append((*own, np.array(fits, bool)))
        if len(parts) == 1:
            return parts[0]
        order = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]))
        a, n_a, b, n_b, fits = (np.concatenate(p) for p in zip(*parts, strict=True))
        return bpe.gather(a, n_a, order), n_a[order], bpe.gather(b, n_b, order), n_b[order], fits[order]

    def _aligned(self, chunks: list[str], number: np.ndarray, per_text: np.ndarray) -> Aligned:
        a, n_a, b, n_b, fits = self._tokens(chunks)
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        links = a[at_a] * B_IDS + b[at_b]
        link_start = np.concatenate([[0], np.searchsorted(at_a, np.cumsum(n_a))])
        return Aligned(number, per_text, fits, a, b, n_a, n_b, links, at_a, at_b, link_start)


def pair_counts(docs: DataFrame, shared, text: str = "text", most_rows: int = 1_000_000) -> DataFrame:
    """(pair, n): linked id pairs as a * B_IDS + b with counts, added up within each task only; at most `most_rows` are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(shared.value)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pairs = np.concatenate([p for p, _ in held])
            pair, of = np.unique(pairs, return_inverse=True)
            n = np.zeros(len(pair), np.int64)
            np.add.at(n, of, np.concatenate([c for _, c in held]))
            return pair, n

        for batch in batches:
            for at, rows in bpe.slices(batch.column(0)):
                for _, x in aligner.batches(batch.column(0).slice(at, rows)):
                    times = np.bincount(x.number[np.repeat(x.text_fits(), x.per_text)], minlength=len(x.n_a))
                    n = np.repeat(times, np.diff(x.link_start))
                    held.append((x.links[n > 0], n[n > 0]))
                if sum(len(p) for p, _ in held) > most_rows:
                    held = [merged()]
                    if len(held[0][0]) > most_rows:
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in held[0]], ["pair", "n"])
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in merged()], ["pair", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "pair long, n long")


# ------------------------------------------------------------------ minimal perfect hash


def build_hash(keys: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """(levels, keys by slot) of a minimal perfect hash over distinct keys.

    On each level a key takes the place its hash names if no other open key wants it, and the rest go on to the next level;
    the slot of a key is the number of places taken before its own. A level is a bit array of 1.5 places per open key.
    """
    levels, slots = [], []
    keys = np.sort(keys.astype(np.uint64))
    while len(keys):
        size = 64 * max(1, math.ceil(1.5 * len(keys) / 64))
        place = _place(keys, len(levels), size)
        taken = np.bincount(place, minlength=size) == 1
        mine = taken[place]
        levels.append((size, np.packbits(taken, bitorder="little").view("<u8")))
        slots.append(keys[mine][np.argsort(place[mine])])
        keys = keys[~mine]
    return levels, np.concatenate(slots) if slots else keys


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(mixed(keys) + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots of keys; -1 for a key that is not in the set, as the keys by slot tell."""

    def __init__(self, levels: list[tuple[int, np.ndarray]], keys: np.ndarray):
        self.keys, self.levels, before = keys, [], 0
        for size, words in levels:
            rank = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.levels.append((size, words, rank - np.bitwise_count(words) + before))
            before += int(rank[-1])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        keys = keys.astype(np.uint64)
        for level, (size, words, rank) in enumerate(self.levels):
            place = _place(keys[todo], level, size)
            word, bit = words[place >> 6], (place & 63).astype(np.uint64)
            taken = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[taken]] = (rank[place >> 6] + below)[taken]
            todo = todo[~taken]
            if not len(todo):
                break
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)


def _shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(pairs.astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(shards)).astype(np.int64)


def _packed_levels(levels: list[tuple[int, np.ndarray]]) -> bytes:
    return b"".join(np.array([size], "<u8").tobytes() + words.tobytes() for size, words in levels)


def _levels(packed: bytes) -> list[tuple[int, np.ndarray]]:
    out, at, all_words = [], 0, np.frombuffer(packed, "<u8")
    while at < len(all_words):
        size = int(all_words[at])
        out.append((size, all_words[at + 1 : at + 1 + size // 64]))
        at += 1 + size // 64
    return out


def hashed_counts(partial: DataFrame, shard_size: int = SHARD, fan: int = FAN) -> DataFrame:
    """(shard, levels, keys, counts): minimal perfect hashes of the distinct pairs of a written (pair, n) table, one per shard of
    about `shard_size` keys, with the keys and the dense count vector by slot as 64-bit little-endian numbers.

    The rows are cut into blocks of a shard; each block becomes a dense vector, and vectors are summed as a tree of `fan` at a time.
    Blocks have as many rows as a shard has keys on average, so vectors take no more room than the rows, and hot pairs
    spread over the blocks. Distinct keys spread evenly over shards.
    """
    distinct = cut(partial.select("pair").distinct())
    n_keys, n_rows = distinct.count(), partial.count()
    shards = max(1, math.ceil(n_keys / shard_size))
    blocks = max(1, math.ceil(n_rows / max(1, n_keys)))

    def with_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            pairs = batch.column(0).to_numpy(zero_copy_only=False)
            shard, block = _shard_of(pairs, shards), (np.arange(len(pairs)) + turn) % blocks
            turn += len(pairs)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(block)], [*batch.schema.names, "shard", "block"])

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        levels, keys = build_hash(pdf["pair"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "levels": [_packed_levels(levels)], "keys": [keys.tobytes()]})

    def vector(key: tuple, rows: pd.DataFrame, hashes: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(hashes["keys"].iloc[0], np.uint64)
        slots = PerfectHash(_levels(hashes["levels"].iloc[0]), keys).slots(rows["pair"].to_numpy())
        if (slots < 0).any():
            raise AssertionError("a pair without a slot")
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, slots, rows["n"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "block": [key[1]], "counts": [counts.tobytes()]})

    def summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, np.int64) for c in pdf["counts"]], axis=0)
        return pd.DataFrame({"shard": [key[0]], "block": [key[1]], "counts": [total.tobytes()]})

    dealt = distinct.mapInArrow(with_shard, "pair long, shard long, block long")
    hashes = cut(dealt.groupBy("shard").applyInPandas(build, "shard long, levels binary, keys binary"))
    rows = partial.select("pair", "n").mapInArrow(with_shard, "pair long, n long, shard long, block long")
    per_block = hashes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    vectors = rows.groupBy("shard", "block").cogroup(per_block.groupBy("shard", "block"))
    level = vectors.applyInPandas(vector, "shard long, block long, counts binary")
    while blocks > 1:
        blocks = math.ceil(blocks / fan)
        level = level.withColumn("block", F.floor(F.col("block") / fan)).groupBy("shard", "block").applyInPandas(summed, "shard long, block long, counts binary")
    return cut(hashes.join(level.select("shard", "counts"), "shard"))


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for keys, counts in zip(batch["keys"], batch["counts"], strict=True):
            yield pd.DataFrame({"pair": np.frombuffer(keys, np.int64), "n": np.frombuffer(counts, np.int64)})


def listed(table: DataFrame) -> DataFrame:
    """(pair, n) rows of a `hashed_counts` table."""
    return table.select("keys", "counts").mapInPandas(_listed, "pair long, n long")


def highest(table: DataFrame) -> dict[int, int]:
    """The largest count of each B id; at most as many as B has ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _listed(batches):
            yield rows.assign(b=rows["pair"] % B_IDS).groupby("b", as_index=False)["n"].max()

    best = table.select("keys", "counts").mapInPandas(run, "b long, n long").groupBy("b").agg(F.max("n").alias("n"))
    return {r["b"]: r["n"] for r in best.collect()}


_OUT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(
    spark: SparkSession, docs: DataFrame, tokenizers: Tokenizers, key: str = "doc_id", text: str = "text", most_shared: int = MOST_SHARED
) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    Offsets where tokens of A and B both end cut a text into groups, and the two tokens that end there are linked. The first pass counts
    linked id pairs over all texts (`pair_counts`, `hashed_counts`); the second aligns again and looks the counts up. n_best counts the
    links whose count is the highest of their B id, count_sum adds up the counts of all links. Null and empty texts and those that one
    tokenizer does not spell have zeros and ''; rows that repeat are counted each; null keys stay; other columns are not read.

    Up to `most_shared` distinct pairs the hash and counts are shipped to the workers (about 20 bytes a pair); beyond that
    the second pass joins the linked pairs of each row with the counts instead, with the same results.
    """
    shared = spark.sparkContext.broadcast(tokenizers)
    table = hashed_counts(cut(pair_counts(docs, shared, text)))
    best = highest(table)
    n = table.agg(F.coalesce(F.sum(F.octet_length("keys") / 8), F.lit(0))).first()[0]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if n > most_shared:
        return _joined(rows, shared, table, best).withColumnRenamed("key", key)
    found = {r["shard"]: (r["levels"], r["keys"], r["counts"]) for r in table.collect()}
    lookup = spark.sparkContext.broadcast((found, max(1, len(found)), best))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(shared.value)
        packed, shards, highest_of = lookup.value
        hashes = {s: (PerfectHash(_levels(v), np.frombuffer(k, np.uint64)), np.frombuffer(c, np.int64)) for s, (v, k, c) in packed.items()}
        top = np.zeros(B_IDS, np.int64)
        top[list(highest_of)] = list(highest_of.values())

        def counts_of(pairs: np.ndarray) -> np.ndarray:
            out, shard = np.zeros(len(pairs), np.int64), _shard_of(pairs, shards)
            for s, (h, counts) in hashes.items():
                mine = np.flatnonzero(shard == s)
                slots = h.slots(pairs[mine])
                out[mine] = np.where(slots < 0, 0, counts[slots])  # a pair of texts that do not count has no slot
            return out

        for batch in batches:
            for at, size in bpe.slices(batch.column(1)):
                for number, x in aligner.batches(batch.column(1).slice(at, size)):
                    if not len(number):
                        continue
                    unique, of = np.unique(x.links, return_inverse=True)
                    count = counts_of(unique)
                    is_best = count == top[unique % B_IDS]
                    run_sum = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[of])])[x.link_start])  # noqa: E731, B023
                    yield _batch(batch.column(0).slice(at, size).take(pa.array(number)), x, run_sum(is_best.astype(np.int64)), run_sum(count))

    return rows.mapInArrow(run, f"key {kind}, {_OUT}").withColumnRenamed("key", key)


def _batch(keys: pa.Array, x: Aligned, best: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    fits = x.text_fits()
    sums = [np.where(fits, x.text_sums(v), 0) for v in (x.n_a, x.n_b, np.diff(x.link_start), best, count)]
    texts, number, sha = x.group_texts().to_pylist(), x.number.tolist(), []
    end = 0
    for n, fit in zip(x.per_text.tolist(), fits.tolist(), strict=True):
        end += n
        sha.append(hashlib.sha256(";".join(map(texts.__getitem__, number[end - n : end])).encode()).hexdigest() if fit and n else "")
    n_a, n_b, groups, n_best, count_sum = (pa.array(v, pa.int64()) for v in sums)
    return pa.RecordBatch.from_arrays([keys, n_a, n_b, groups, groups, n_best, count_sum, pa.array(sha, pa.string())], ["key", *(c.split()[0] for c in _OUT.split(", "))])


def _joined(rows: DataFrame, shared, table: DataFrame, best: dict[int, int]) -> DataFrame:
    """The second pass by a join: each row's distinct linked pairs with their number, then counts by pair, then sums by row."""
    spark = rows.sparkSession
    tops = spark.createDataFrame([(int(b), int(n)) for b, n in best.items()], "b long, top long")
    schema = f"row long, key {rows.schema['key'].dataType.simpleString()}, {_OUT}, pairs array<struct<pair: long, times: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(shared.value)
        made = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, size in bpe.slices(batch.column(1)):
                for number, x in aligner.batches(batch.column(1).slice(at, size)):
                    if not len(number):
                        continue
                    zero = np.zeros(len(x.n_a), np.int64)
                    out = _batch(batch.column(0).slice(at, size).take(pa.array(number)), x, zero, zero)
                    chunk_links, listed_pairs, end = np.diff(x.link_start), [], 0
                    for n, fit in zip(x.per_text.tolist(), x.text_fits().tolist(), strict=True):
                        end += n
                        mine = bpe.gather(x.links, chunk_links, x.number[end - n : end]) if fit else zero[:0]
                        pair, times = np.unique(mine, return_counts=True)
                        listed_pairs.append([{"pair": p, "times": t} for p, t in zip(pair.tolist(), times.tolist(), strict=True)])
                    ids = np.arange(made, made + len(number))
                    made += len(number)
                    kind = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), *out.columns, pa.array(listed_pairs, kind)], ["row", *out.schema.names, "pairs"])

    plain = cut(rows.mapInArrow(run, schema))
    pairs = plain.select("row", F.explode("pairs").alias("p")).select("row", "p.pair", "p.times", (F.col("p.pair") % B_IDS).alias("b"))
    counted = pairs.join(listed(table), "pair").join(tops, "b").groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("n") * F.col("times")).alias("total"),
    )
    done = plain.drop("pairs", "n_best", "count_sum").join(counted, "row", "left")
    return done.select(
        "key", "n_a", "n_b", "n_groups", "n_links", F.coalesce("best", F.lit(0)).alias("n_best"), F.coalesce("total", F.lit(0)).alias("count_sum"), "groups_sha256"
    )
