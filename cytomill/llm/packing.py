"""Packing of tokenised documents into sequences by multiway differencing."""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomill.llm import bpe
from cytomill.session import cut

def pieces(
    spark: SparkSession, docs: DataFrame, file: str, capacity: int = 4096, end_id: int = 2, end_of_word: str = "</w>", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): each document's ids and the end id, cut every `capacity` ids.

    Only the last piece of a document can be shorter. Null and empty texts have the end id alone; rows with the same key are documents
    of their own; other columns are not read. Whole texts are encoded, a few megabytes at a time.
    """
    with open(file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast((bpe.ranks_of_merges(file, end_of_word), f.read()))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = bpe.WordTokens(*shared.value)
        for batch in batches:
            for at, rows in bpe.slices(batch.column(1)):
                part = batch.slice(at, rows)
                ids, counts = tokens.of(part.column(1))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                counts = counts + 1
                n = -(-counts // capacity)
                of = np.repeat(np.arange(rows), n)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, counts[of] - start)
                raw, first = memoryview(ids.tobytes()), (np.cumsum(counts) - counts)[of] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(first.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of)), *(pa.array(c, pa.int64()) for c in (start, length, crc, counts[of]))],
                    ["key", "start", "length", "ids_crc32", "doc_tokens"],
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long").withColumnRenamed("key", key)


def difference(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each item, window sums): the multiway differencing of Karmarkar and Karp over k windows.

    Every item starts as a partial partition with one filled window. The two partitions of the largest imbalance (fullest minus
    emptiest window) are merged again and again, the fullest windows of one onto the emptiest of the other. Only filled windows are
    stored; a window is a tree of merges, resolved at the end. Ties go to the partition that was made first.
    """
    n = len(lengths)
    if k == 1:
        return np.zeros(n, np.int64), np.array([lengths.sum()])
    parts: list[tuple[np.ndarray, np.ndarray] | None] = [(lengths[i : i + 1], np.array([i])) for i in range(n)]
    joined: list[np.ndarray] = []
    nodes = n
    heap = [(-int(v), i) for i, v in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, p), (_, q) = heapq.heappop(heap), heapq.heappop(heap)
        (a, at_a), (b, at_b) = parts[p], parts[q]
        parts[p] = parts[q] = None
        both = len(a) + len(b) - k  # so many filled windows of either side meet; sums are kept by falling size
        if both > 0:
            lone_a, lone_b = len(a) - both, len(b) - both
            met = a[lone_a:] + b[lone_b:][::-1]
            joined.append(np.stack([at_a[lone_a:], at_b[lone_b:][::-1]], 1))
            sums = np.concatenate([a[:lone_a], b[:lone_b], met])
            own = np.concatenate([at_a[:lone_a], at_b[:lone_b], np.arange(nodes, nodes + both)])
            nodes += both
        else:
            sums, own = np.concatenate([a, b]), np.concatenate([at_a, at_b])
        order = np.argsort(-sums, kind="stable")
        sums, own = sums[order], own[order]
        parts.append((sums, own))
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), len(parts) - 1))
    sums, own = parts[heap[0][1]]
    window = np.full(nodes, -1, np.int64)
    window[own] = np.arange(len(own))
    for at, children in zip(range(nodes, n, -1), (c for block in reversed(joined) for c in block[::-1]), strict=False):
        window[children] = window[at - 1]
    return window[:n], sums


def near_equal(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item, no window over capacity: as few windows as the total needs, and more whenever differencing passes capacity."""
    total = int(lengths.sum())
    k = max(1, math.ceil(total / capacity))
    while True:
        window, sums = difference(lengths, k)
        if sums.max() <= capacity:
            return window
        # the same imbalance around a lower mean would fit with so many
        k = max(k + 1, min(len(lengths), math.ceil(total / max(1.0, capacity - (sums.max() - total / k)))))


def pack(cut_pieces: DataFrame, capacity: int = 4096, group: int = 2048, rows_per_task: int = 64 * 2048) -> DataFrame:
    """The pieces with sequence_id and offset: full pieces are sequences of their own, shorter ones share near-equal windows.

    The pieces must be a written table, so that a task that runs again sees the same rows. They are dealt out evenly, whatever their
    keys, and each task packs them in groups of at most `group`, so memory and time a group are bounded and copies of one row spread.
    """
    n = cut_pieces.count()
    tasks = max(1, math.ceil(n / rows_per_task))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = TaskContext.get().partitionId() << 40
        held: list[pd.DataFrame] = []

        def packed(short: pd.DataFrame) -> pd.DataFrame:
            nonlocal made
            window = near_equal(short["length"].to_numpy(), capacity)
            order = np.argsort(window, kind="stable")
            out, window = short.iloc[order].reset_index(drop=True), window[order]
            before = out["length"].cumsum() - out["length"]
            offset = (before - before.groupby(window).transform("first")).astype(np.int64)
            _, dense = np.unique(window, return_inverse=True)
            out = out.assign(sequence_id=made + dense.astype(np.int64), offset=offset)
            made += int(dense.max()) + 1
            return out

        for batch in batches:
            full = batch["length"] == capacity
            whole = batch[full]
            if len(whole):
                yield whole.assign(sequence_id=np.arange(made, made + len(whole), dtype=np.int64), offset=np.int64(0))
                made += len(whole)
            held.append(batch[~full])
            if sum(map(len, held)) >= group:
                short = pd.concat(held, ignore_index=True)
                last = len(short) // group * group
                for at in range(0, last, group):
                    yield packed(short.iloc[at : at + group])
                held = [short.iloc[last:]]
        short = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if len(short):
            yield packed(short)

    return cut_pieces.repartition(tasks).mapInPandas(run, schema)


def pack_documents(
    spark: SparkSession, docs: DataFrame, file: str, capacity: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document; an empty table gives no rows."""
    return pack(cut(pieces(spark, docs, file, capacity, end_id, key=key, text=text)), capacity)
