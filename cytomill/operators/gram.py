"""Gram matrices of row vectors, folded inside tasks, and what is read off them: correlated features, class consistency."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomill.session import cut

#: Longest vectors, and numbers of partial matrices that a task keeps and that a band of rows has.
MOST, HELD, BAND = 4096, 1 << 24, 1 << 17
FAN = 64


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def gram_rows(vectors: DataFrame, d: int, group: str = "group") -> DataFrame:
    """(group, first, band): sums over a group's vectors x (array<double> of length d) of x x', in bands of rows as bytes.

    A task folds its batches into one matrix a group and hands on all when they grow too many; matrices are then summed band by
    band in two steps, so no task meets more than a share of the partial ones. Rows never pair with rows.
    """
    if d > MOST:
        raise ValueError(f"vectors of {d} entries; at most {MOST}")
    rows = max(1, BAND // max(d, 1))
    kind = vectors.schema[group].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        salt = TaskContext.get().partitionId() % FAN

        def bands() -> Iterator[pa.RecordBatch]:
            for g, m in held.items():
                starts = list(range(0, d, rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * len(starts), key_type), pa.array([salt] * len(starts), pa.int64()), pa.array(starts, pa.int64()), pa.array([m[s : s + rows].tobytes() for s in starts])],
                    ["group", "salt", "first", "band"],
                )
            held.clear()

        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            coded = batch.column(0).dictionary_encode()
            number = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            x = _vectors(batch.column(1), d)
            for i, g in enumerate([*coded.dictionary.to_pylist(), None]):
                mine = x[number == i]
                if len(mine):
                    held[g] = held.get(g, 0.0) + mine.T @ mine
            if len(held) * d * d > HELD:
                yield from bands()
        if held:
            yield from bands()

    def summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b) for b in pdf["band"]], axis=0)
        return pd.DataFrame({"group": pd.Series([pdf["group"].iloc[0]], dtype=pdf["group"].dtype), "first": [pdf["first"].iloc[0]], "band": [total.tobytes()]})

    schema = f"group {kind}, first long, band binary"
    parts = vectors.select(F.col(group).alias("group"), "x").mapInArrow(fold, f"group {kind}, salt long, first long, band binary")
    halfway = parts.groupBy("group", "first", "salt").applyInPandas(summed, schema)
    return halfway.groupBy("group", "first").applyInPandas(summed, schema).withColumnRenamed("group", group)


def feature_moments(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, n, mean, variance), NULL and NaN counting as 0; deviations are merged batch by batch, not from raw squares."""
    names = list(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, dev = 0, np.zeros(len(names)), np.zeros(len(names))
        for batch in batches:
            x = _stacked(batch)
            if m := len(x):
                own = x.mean(0)
                dev += ((x - own) ** 2).sum(0) + (own - mean) ** 2 * (n * m / (n + m))
                mean += (own - mean) * (m / (n + m))
                n += m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([n] * len(names), pa.int64()), pa.array(mean), pa.array(dev)], ["feature", "n", "mean", "dev"])

    parts = _columns(wide, names).mapInArrow(run, "feature string, n long, mean double, dev double")
    total = parts.groupBy("feature").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    spread = parts.join(total.withColumnsRenamed({"n": "all", "mean": "centre"}), "feature").groupBy("feature").agg(
        (F.sum(F.col("dev") + F.col("n") * (F.col("mean") - F.col("centre")) ** 2) / F.first("all")).alias("variance")
    )
    return total.join(spread, "feature")


def _columns(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    """The feature columns as they are; hundreds of expressions around them would outgrow compiled code."""
    return wide.select(*[F.col(f"`{c}`").cast("double") for c in features])


def _stacked(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of a batch of columns, NULL and NaN as 0."""
    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
    return np.where(np.isnan(x), 0.0, x)


def correlated_pairs(wide: DataFrame, features: Sequence[str], threshold: float | None = None) -> DataFrame:
    """(i, j, a, b, r) of feature pairs a before b, all of them or those with |r| over the threshold; NULL and NaN count as 0.

    One pass for means, one for the Gram matrix of the centred rows; a pair leaves its band only if it is wanted. r is null for a
    feature without spread.
    """
    names = list(features)
    moments = {r["feature"]: (r["mean"], r["variance"] * r["n"]) for r in feature_moments(wide, names).collect()}  # one row a feature
    if not moments:
        return wide.sparkSession.createDataFrame([], "i long, j long, a string, b string, r double")
    mean, own = (np.array([moments[c][k] for c in names]) for k in (0, 1))

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stacked(batch) - mean
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(names), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int64)), flat], ["group", "x"])

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scale = np.sqrt(np.where(own > 0, own, np.nan))
        for batch in batches:
            for first, band in zip(batch["first"], batch["band"], strict=True):
                m = np.frombuffer(band).reshape(-1, len(names))
                r = m / scale[first : first + len(m), None] / scale[None]
                later = np.arange(len(names))[None] > (first + np.arange(len(m)))[:, None]
                i, j = np.nonzero(later if threshold is None else later & (np.abs(r) > threshold))
                a, b = (pd.Series([names[k] for k in at], dtype=object) for at in (i + first, j))
                yield pd.DataFrame({"i": i + first, "j": j, "a": a, "b": b, "r": r[i, j]})

    grams = gram_rows(_columns(wide, names).mapInArrow(centre, "group long, x array<double>"), len(names))
    found = grams.select("first", "band").mapInPandas(pairs, "i long, j long, a string, b string, r double")
    return found.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def select_uncorrelated(wide: DataFrame, features: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """(feature, n, mean, variance) of the features that stay: in feature order, of a pair over the threshold the one with the
    lower variance goes.

    The scan is sequential by definition. It reads the pairs over the threshold in order, one partition at a time, and
    holds one flag a feature.
    """
    names = list(features)
    moments = cut(feature_moments(wide, names))
    variance = {r["feature"]: r["variance"] for r in moments.select("feature", "variance").collect()}
    gone: set[int] = set()
    left_out = -1  # a feature that was gone before its turn has no say
    current = None
    over = cut(correlated_pairs(wide, names, threshold).select("i", "j")).orderBy("i", "j")
    for row in over.toLocalIterator():
        i, j = row["i"], row["j"]
        if i != current:
            current, left_out = i, i in gone
        if not left_out and j not in gone:
            gone.add(i if variance[names[i]] < variance[names[j]] else j)
    return moments.where(~F.col("feature").isin([names[i] for i in sorted(gone)])) if gone else moments
