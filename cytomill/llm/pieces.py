"""Sampled SentencePiece segmentations: forward filtering and backward sampling over the piece lattice, and lossless decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cytomill.llm.bpe import gather
from cytomill.llm.wordhash import BASES, mixed

#: Fixed value: the mark that stands for a space in pieces.
SPACE = "▁"
ONE = 1 << 31
#: Rows that a worker hands back together.
ROWS = 256


class Pieces:
    """A vocabulary read from a SentencePiece model with byte fallback.

    The model ranks its pieces but gives no probabilities, so a piece of rank r weighs 1 / (r + 2) to the power `sharpness`; the
    larger it is, the closer samples stay to the likeliest segmentation. A character without a piece of its own is spelt in
    bytes, and so is a literal space mark, which keeps decoding lossless.
    """

    def __init__(self, model_file: str, sharpness: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.weights: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [-1] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.weights[piece.replace(SPACE, " ")] = i, (2 - model.get_score(i)) ** -sharpness
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        if min(self.byte_ids) < 0:
            raise ValueError("the model has no byte fallback")
        self.longest = max(map(len, self.weights))
        self.byte_weight = (2.0 + len(self.bytes_of)) ** -sharpness
        self._grow_trie()
        # no piece runs from a word into a space, so chunks "spaces, then others" are independent; so are line ends without pieces
        if any(re.search("[^ ] ", p) for p in self.weights) or self.longest > 31:
            raise ValueError("a piece runs over a word's end or is too long")
        self.chunk = re.compile(" *[^ ]+| +" if any("\n" in p for p in self.weights) else " *[^ \n]+|\n| +")

    def _grow_trie(self) -> None:
        """The pieces as a trie in arrays: character classes, sorted (state, class) keys with next states, and what ends where."""
        letters = sorted({ord(c) for p in self.weights for c in p})
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        step: dict[int, int] = {}
        ends: list[tuple[int, int, float]] = []
        for piece, (number, weight) in self.weights.items():
            state = 0
            for c in piece:
                state = step.setdefault(state * self.width + int(self.class_of[ord(c)]), len(step) + 1)
            ends.append((state, number, weight))
        keys = np.fromiter(step, np.int64, len(step))
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.fromiter(step.values(), np.int64, len(step))[order]
        self.root = np.full(self.width, -1, np.int64)  # the first step, which all places take
        first = self.keys < self.width
        self.root[self.keys[first]] = self.next[first]
        self.ends, self.end_weight = np.full(len(step) + 1, -1, np.int32), np.zeros(len(step) + 1)
        for state, number, weight in ends:
            self.ends[state], self.end_weight[state] = number, weight

    def decode(self, ids) -> str | None:
        """The text of a segmentation; its first byte is the space put before every text."""
        return None if ids is None else b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


class Lattices:
    """Filtered lattices of chunks in flat arrays: each node (a place behind a character) lists its incoming edges with cumulative
    probabilities in units of 1 / ONE, likeliest first."""

    def __init__(self, pieces: Pieces, most: int = 40_000):
        self.pieces, self.most = pieces, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.size, self.first_node, self.node_start = (np.zeros(0, np.int64) for _ in range(3))
        self.upto, self.back, self.piece = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.spelt: list[bytes] = []
        self.uses = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Leaves the chunks used most, at most half of `most` and only those used twice or more, and forgets the rest."""
        often = np.argsort(-self.uses, kind="stable")[: self.most // 2]
        kept = np.sort(often[self.uses[often] > 1])
        names = list(self.place)
        self.place = {names[i]: k for k, i in enumerate(kept.tolist())}
        per_node = np.diff(np.append(self.node_start, len(self.upto)))
        nodes = np.concatenate([np.arange(a, a + n) for a, n in zip(self.first_node[kept], self.size[kept], strict=True)] or [kept])
        edges = gather(np.arange(len(self.upto)), per_node, nodes)
        self.size, self.uses = self.size[kept], np.zeros(len(kept), np.int64)
        self.first_node, self.node_start = np.cumsum(self.size) - self.size, np.cumsum(per_node[nodes]) - per_node[nodes]
        self.upto, self.back, self.piece = self.upto[edges], self.back[edges], self.piece[edges]
        used, which = np.unique(self.piece[self.piece < 0], return_inverse=True)
        self.spelt = [self.spelt[-u - 1] for u in used.tolist()]
        self.piece[self.piece < 0] = -1 - which.astype(np.int32)

    def chunks(self, found: list[str]) -> np.ndarray:
        """Numbers of chunks, with the lattices of new ones."""
        new = [c for c in dict.fromkeys(found) if c not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
            self._add(new)
        numbers = np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))
        uses = np.bincount(numbers, minlength=len(self.size))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        return numbers

    def _edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """(end place, length, piece, weight) of all pieces at all places; `left` is how many characters the chunk still has."""
        v, kind = self.pieces, self.pieces.class_of[codes]
        out, at, state = [], np.arange(len(codes)), np.zeros(len(codes), np.int64)
        single = np.zeros(len(codes), bool)
        for d in range(1, v.longest + 1):
            if d == 1:
                state = v.root[kind]
                fits = state >= 0
                at, state = at[fits], state[fits]
            else:
                key = state * v.width + kind[at + d - 1]
                slot = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
                fits = v.keys[slot] == key
                at, state = at[fits], v.next[slot[fits]]
            whole = v.ends[state] >= 0
            out.append((at[whole] + d - 1, np.full(int(whole.sum()), d, np.int32), v.ends[state[whole]], v.end_weight[state[whole]]))
            if d == 1:
                single[at[whole]] = True
            longer = left[at] > d
            at, state = at[longer], state[longer]
        strange = np.flatnonzero(~single)
        for c in codes[strange].tolist():
            self.spelt.append(chr(c).encode("utf-8", "surrogatepass"))
        n = len(self.spelt)
        sizes = np.fromiter(map(len, self.spelt[n - len(strange) :]), np.int64, len(strange))
        spell = -np.arange(n - len(strange) + 1, n + 1, dtype=np.int32)
        out.append((strange, np.ones(len(strange), np.int32), spell, v.byte_weight ** sizes.astype(float)))
        return tuple(np.concatenate(p) for p in zip(*out, strict=True))

    def _add(self, new: list[str]) -> None:
        """Forward filtering: a node weighs the sum over pieces that end there of the weight at their start times their own.

        All chunks take one character a step; weights are kept relative to the newest node, as only ratios within reach of
        one piece matter.
        """
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        codes = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(new)), sizes)
        inside = np.arange(len(codes)) - first[owner]
        end, length, piece, weight = self._edges(codes, sizes[owner] - inside)
        order = np.argsort((inside[end] << 36) + (end << 5) + length)  # unique keys: by step, place, length
        end, length, piece, weight = end[order], length[order], piece[order], weight[order]
        rank = np.empty(len(new), np.int64)
        rank[np.argsort(-sizes, kind="stable")] = np.arange(len(new))  # long chunks first: those still open stay in front
        row = rank[owner[end]]
        steps = np.searchsorted(inside[end], np.arange(int(sizes.max()) + 1))
        share = np.empty(len(end))
        reach = np.zeros((len(new), self.pieces.longest))
        reach[:, 0] = 1.0
        for lo, hi in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            weighed = weight[lo:hi] * reach[row[lo:hi], length[lo:hi] - 1]
            heads = np.flatnonzero(np.diff(end[lo:hi], prepend=-1))
            total = np.add.reduceat(weighed, heads)
            share[lo:hi] = weighed / np.repeat(total, np.diff(np.append(heads, hi - lo)))
            rows = row[lo:hi][heads]
            moved = reach[rows]
            moved[:, 1:] = np.minimum(moved[:, :-1] / total[:, None], 1e300)
            moved[:, 0] = 1.0
            reach[rows] = moved
        unit = (share * ONE).astype(np.int64)
        order = np.argsort((end << 37) + ((ONE - unit) << 5) + length)  # unique keys: by place, falling share, length
        end, unit = end[order], unit[order]
        heads = np.flatnonzero(np.diff(end, prepend=-1))
        run = np.cumsum(unit)
        run -= np.repeat(run[heads] - unit[heads], np.diff(np.append(heads, len(end))))
        run[np.append(heads[1:], len(end)) - 1] = ONE
        grow = lambda old, more: np.concatenate([old, more.astype(old.dtype)])
        self.first_node = grow(self.first_node, first + len(self.node_start))
        self.node_start, self.size = grow(self.node_start, heads + len(self.upto)), grow(self.size, sizes)
        self.upto, self.back, self.piece = grow(self.upto, run), grow(self.back, length[order]), grow(self.piece, piece[order])

    def sample(self, chunk: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per chunk): backward sampling of all chunks at once; `noise` is a 64-bit hash per chunk."""
        node_start, upto, back, piece = self.node_start, self.upto, self.back, self.piece
        at, todo, base = self.size[chunk], np.arange(len(chunk)), self.first_node[chunk] - 1
        steps = []
        while len(todo):
            here = at[todo]
            draw = (mixed(noise[todo] + here.astype(np.uint64) * np.uint64(BASES[1])) >> np.uint64(33)).astype(np.int64)
            edge = node_start[base[todo] + here]
            late = np.flatnonzero(upto[edge] <= draw)
            while len(late):
                edge[late] += 1
                late = late[upto[edge[late]] <= draw[late]]
            steps.append((todo, piece[edge]))
            at[todo] = here - back[edge]
            todo = todo[at[todo] > 0]
        counts = np.zeros(len(chunk), np.int64)
        for owners, _ in steps:
            counts[owners] += 1
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (owners, drawn) in enumerate(steps):
            ids[ends[owners] - 1 - k] = drawn
        if self.spelt and (ids < 0).any():
            ids, counts = self._spell(ids, counts)
        return ids, counts

    def _spell(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts the byte pieces in the place of characters without a piece."""
        used, which = np.unique(ids[ids < 0], return_inverse=True)
        spelt = [[self.pieces.byte_ids[b] for b in self.spelt[-u - 1]] for u in used]
        sizes = np.array([len(s) for s in spelt], np.int64)
        lengths = np.ones(len(ids), np.int64)
        lengths[ids < 0] = sizes[which]
        out = np.repeat(ids, lengths)
        out[out < 0] = np.fromiter((b for w in which.tolist() for b in spelt[w]), np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(owner, lengths, len(counts)).astype(np.int64)


def sample_texts(texts: list[str], keys: list[str], lattices: Lattices, seed: int, most_chunks: int = 30_000) -> list[np.ndarray]:
    """Sampled ids of each text. The draw of a chunk depends on seed, row key and the chunk's number in its text only, so any
    batching gives the same ids; long texts are drawn in parts."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, np.uint64, int, list[str]]] = []

    def draw() -> None:
        if len(lattices.place) > lattices.most:
            lattices.forget()
        if held:
            chunk = lattices.chunks([c for h in held for c in h[3]])
            ids, counts = lattices.sample(chunk, np.concatenate([_noise(row, first, len(found)) for _, row, first, found in held]))
            ends = np.cumsum(counts)[np.cumsum([len(h[3]) for h in held]) - 1]
            for (i, *_), got in zip(held, np.split(ids, ends[:-1]), strict=True):
                parts[i].append(got.astype(np.int32))
            held.clear()

    size = 0
    for i, (text, key) in enumerate(zip(texts, keys, strict=True)):
        row = np.uint64(xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"), seed))
        number = 0
        for part in _parts(" " + text) if text else ():
            found = lattices.pieces.chunk.findall(part)
            held.append((i, row, number, found))
            number, size = number + len(found), size + len(found)
            if size >= most_chunks:
                draw()
                size = 0
    draw()
    return [np.concatenate(p) if p else np.zeros(0, np.int32) for p in parts]


def _parts(text: str, most: int = 1 << 18) -> Iterator[str]:
    """The text in parts of about `most` characters, cut where a space follows another character, as chunks are."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + most)
        while end > 0 and text[end - 1] == " ":
            end = text.find(" ", end + 1)
        end = end if end > 0 else len(text)
        yield text[at:end]
        at = end


def _noise(row: np.uint64, first: int, n: int) -> np.ndarray:
    return mixed(row + np.arange(first, first + n).astype(np.uint64) * np.uint64(BASES[0]))


def _sampled(batches: Iterator[tuple[pd.Series, pd.Series]], pieces: Pieces, seed: int) -> Iterator[tuple[pd.Series, pd.Series]]:
    """(texts, their sampled ids) in parts, so that the ids of a large batch need not stand in memory together."""
    lattices = Lattices(pieces)
    for keys, texts in batches:
        for at in range(0, len(texts), ROWS):
            some = texts.iloc[at : at + ROWS]
            ids = sample_texts([t or "" for t in some], ["" if k is None else k for k in keys.iloc[at : at + ROWS]], lattices, seed)
            yield some, pd.Series([None if t is None else x for t, x in zip(some, ids, strict=True)], dtype=object)


def encode(spark: SparkSession, key: Column, text: Column, pieces: Pieces, seed: int = 0) -> Column:
    """Column of sampled piece ids (array<int>) of each whole text, seeded by the row key.

    Null texts give null and empty ones no pieces. Rows with equal keys and texts get equal ids; a null key counts as the empty string.
    """
    shared = spark.sparkContext.broadcast(pieces)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for _, ids in _sampled(batches, shared.value, seed):
            yield ids

    return run.asNondeterministic()(key.cast("string"), text)


def encode_checked(spark: SparkSession, key: Column, text: Column, pieces: Pieces, seed: int = 0) -> Column:
    """Column of (ids, lossless): as `encode`, and whether `decode` makes the text of the ids again.

    Both are done by one worker; an `encode` with a `decode` behind it holds two workers with a vocabulary each in every task.
    """
    shared = spark.sparkContext.broadcast(pieces)

    @F.pandas_udf("ids array<int>, lossless boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ids in _sampled(batches, shared.value, seed):
            same = [shared.value.decode(None if x is None else x.tolist()) == t for t, x in zip(texts, ids, strict=True)]
            yield pd.DataFrame({"ids": ids.reset_index(drop=True), "lossless": same})

    return run.asNondeterministic()(key.cast("string"), text)


def decode(spark: SparkSession, ids: Column, pieces: Pieces) -> Column:
    """Column of the texts of piece ids; null for null."""
    shared = spark.sparkContext.broadcast(pieces)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for each in batches:
            for at in range(0, len(each), ROWS):
                yield pd.Series([shared.value.decode(None if x is None else x.tolist()) for x in each.iloc[at : at + ROWS]], dtype=object)

    return run.asNondeterministic()(ids)
