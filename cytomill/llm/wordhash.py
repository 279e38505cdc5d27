"""Hashes of words and of windows of words, and tables that end a shuffle."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from cytomill.session import cut

#: Odd multipliers of the 64-bit polynomial hashes and of the mixer.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class WordHashes(dict):
    """64-bit hash of a word (bytes); remembers up to `most` words, then starts anew."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(4096, 1 << n.bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[base] = both[0], both[1]
    return _POWERS[base]


def window_hashes(words: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of each window of k consecutive word hashes, the same wherever the window stands."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:n], dtype=np.uint64)])
    return mixed((sums[k:] - sums[:-k]) * down[: n - k + 1])


def settle(df: DataFrame) -> DataFrame:
    """Writes the rows to a table and lets the shuffles behind it go.

    Spark deletes shuffle files once the driver has collected the plans that made them; asking for that here keeps those
    of finished steps from filling the executors' disks.
    """
    out = cut(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out
