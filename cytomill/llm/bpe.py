"""Ids by the public tokenizers, with each distinct word of an Arrow batch encoded once.

Plain Latin words go through rank tables that give exactly the ids of the tokenizer file; all others go through its own library.
A rank table merges any neighbours whose joined bytes are a token, the lowest rank first, while a merge list names the pair. Both
agree when each token is what its own bytes encode to: inside a token's bytes the merges run as they do alone, so neighbours that
join to a reachable token are the pair of its merge. Tokens that their own bytes do not reach are left out of the table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ends a word in the rank table of word tokenizers; plain words never hold it.
END = "\x01"
#: Words that go through rank tables: letters, digits and marks up to U+012F, without controls and Latin-1 spaces.
PLAIN = re.compile("[\t\n !-~¡-įĀ-į]*")
#: Fixed value: pieces of the lower-cased plain words that the word tokenizer encodes apart.
WORD_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-į]+|[0-9²³¹¼-¾]|[^\\sa-zªµºß-öø-į0-9²³¹¼-¾]+|\\s")
#: Fixed value: the pattern that splits text before the merges of the byte tokenizer.
BYTE_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = {b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0)} | {0xAC}
    odd = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(odd)}


def _merged(pieces: list[str], merges: dict[tuple[str, str], int]) -> list[str]:
    """Pieces after all merges of the list, the lowest rank first and leftmost."""
    while len(pieces) > 1:
        rank, at = min((merges.get(pair, len(merges)), i) for i, pair in enumerate(zip(pieces, pieces[1:], strict=False)))
        if rank == len(merges):
            break
        pieces = [*pieces[:at], pieces[at] + pieces[at + 1], *pieces[at + 2 :]]
    return pieces


class Ranks:
    """A rank table (bytes -> rank) and the id and bytes of each rank; built on the driver, shipped to the workers."""

    def __init__(self, table: dict[bytes, int], ids: dict[int, int], pattern: str):
        self.table, self.pattern = table, pattern
        self.ids = np.zeros(max(table.values()) + 1, np.int64)
        for rank, i in ids.items():
            self.ids[rank] = i

    def encoder(self) -> Callable[[str], list[int]]:
        """A function from text to ranks."""
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.table, special_tokens={}).encode_ordinary


def ranks_of_merges(file: str, end: str = "") -> Ranks:
    """Rank table of a byte-level BPE file; `end` is its end-of-word suffix, which END stands for in the table."""
    with open(file, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merges = {pair: i for i, pair in enumerate(pairs)}

    def spelt(token: str) -> bytes:
        last = end and token.endswith(end)
        return bytes(letters[c] for c in (token[: -len(end)] if last else token)) + (END.encode() if last else b"")

    singles = [*letters, *((c + end for c in letters) if end else ())]
    table, ids = {}, {}

    def add(token: str, b: bytes) -> None:
        ids[len(table)] = model["vocab"].get(token, 0)
        table[b] = len(table)

    for token in singles:
        add(token, spelt(token))
    for a, b in pairs:
        token = a + b
        whole = token[: -len(end)] if end and token.endswith(end) else token
        start = list(whole)
        if whole != token:
            start[-1] += end
        if _merged(start, merges) == [token]:
            add(token, spelt(token))
    return Ranks(table, ids, f"(?s)[^{END}]*{END}" if end else BYTE_PIECES)


def ranks_of_pieces(model_file: str) -> tuple[Ranks, list[bytes]]:
    """Rank table of a SentencePiece BPE model with byte fallback, for plain texts, and the bytes of all pieces.

    Characters of two bytes are formed first, then pieces by falling score, as in the model.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    known: dict[bytes, tuple[float, int]] = {}
    spelt, byte_id = [], {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_id[int(piece[3:5], 16)] = i
            spelt.append(bytes([int(piece[3:5], 16)]))
        else:
            spelt.append(piece.replace("▁", " ").encode())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                known[spelt[-1]] = -model.get_score(i), i
    table, ids = {}, {}
    for b in range(256):
        ids[len(table)] = known.get(bytes([b]), (0, byte_id[b]))[1]
        table[bytes([b])] = len(table)
    for c in range(0x80, 0x130):
        if (b := chr(c).encode()) in known:
            ids[len(table)] = known[b][1]
            table[b] = len(table)
    for b, (_, i) in sorted(known.items(), key=lambda x: x[1]):
        if b not in table and PLAIN.fullmatch(b.decode()):
            ids[len(table)] = i
            table[b] = len(table)
    return Ranks(table, ids, "(?s).+"), spelt


def plain_of_pieces(word: str, missing: frozenset[str]) -> bool:
    """Whether a piece model's rank table may encode the word: plain, and each Latin letter has a piece."""
    return PLAIN.fullmatch(word) is not None and missing.isdisjoint(word)


class WordTokens:
    """Ids of texts by a tokenizer file that drops white space and ends words; made in a worker from what the driver read.

    White space never joins a token and no normalisation crosses it, so the ids of a text are those of its words, and each distinct
    word of a batch is encoded once.
    """

    def __init__(self, ranks: Ranks, file_text: str):
        from tokenizers import Tokenizer

        self.ranks, self.encode = ranks, ranks.encoder()
        self.library = Tokenizer.from_str(file_text)
        self.space = ranks.table[b" " + END.encode()]

    def _distinct_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, ids per word)."""
        joined = joined_by_space(words)
        if "<|" in joined or not PLAIN.fullmatch(joined):
            listed = words.to_pylist()
            odd = np.array(["<|" in w or not PLAIN.fullmatch(w) for w in listed], bool)
            ids, counts = self._distinct_ids(words.filter(pa.array(~odd)))
            strange = [e.ids for e in self.library.encode_batch([w for w, o in zip(listed, odd, strict=True) if o], add_special_tokens=False)]
            all_counts = np.empty(len(words), np.int64)
            all_counts[~odd], all_counts[odd] = counts, [len(x) for x in strange]
            out = np.empty(int(all_counts.sum()), ids.dtype)
            whose = np.repeat(odd, all_counts)
            out[~whose], out[whose] = ids, np.array([i for x in strange for i in x], ids.dtype)
            return out, all_counts
        # the pieces of all words, with a lone space between words
        found = WORD_PIECES.findall(joined.lower())
        ranks = np.array(self.encode(END.join(found) + END) if found else [], np.int64)
        gaps = np.flatnonzero(ranks == self.space)
        counts = np.diff(np.concatenate([[-1], gaps, [len(ranks)]])) - 1 if len(words) else np.zeros(0, np.int64)
        return self.ranks.ids[ranks[ranks != self.space]].astype(np.uint32), counts

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text); null texts have none."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = words.filter(pa.array(np.ones(len(words), bool)))  # offsets from zero
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten()
        filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # blank ends of a text give empty words
        owner = np.repeat(np.arange(len(counts)), counts)[filled]
        coded = flat.filter(pa.array(filled)).dictionary_encode()
        ids, per_word = self._distinct_ids(coded.dictionary)
        number = coded.indices.to_numpy(zero_copy_only=False)
        return gather(ids, per_word, number), np.bincount(owner, per_word[number], len(counts)).astype(np.int64)


def joined_by_space(words: pa.Array) -> str:
    if not len(words):
        return ""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), " ")[0].as_py()


def gather(flat: np.ndarray, counts: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The runs of `flat` (of `counts` values each) in the order of `number`."""
    size = counts[number]
    start = (np.cumsum(counts) - counts)[number]
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return flat[at]


def slices(texts: pa.Array, most_rows: int = 10_000, most_bytes: int = 16 << 20) -> Iterator[tuple[int, int]]:
    """(first, rows) of runs of texts of at most so many rows and, unless one text is longer, bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = min(int(np.searchsorted(ends, before + most_bytes, "right")), first + most_rows)
        last = max(last, first + 1)
        yield first, last - first
        first = last
