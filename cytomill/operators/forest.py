"""Random forests on counts of binned rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomill.operators.ordered import counted_quantiles, unfolded
from cytomill.session import cut


def _thresholds(rows: DataFrame, feature: str, bins: int) -> list[float]:
    """Split candidates: between all values when there are at most `bins`, else the exact quantiles. The rows are counted per value once."""
    counts = cut(rows.groupBy(feature).agg(F.count(F.lit(1)).alias("n")))
    few = sorted(r[0] for r in counts.select(feature).limit(bins + 1).collect())
    if len(few) <= bins:
        return [(a + b) / 2 for a, b in pairwise(few)]
    at = {f"q{k}": k / bins for k in range(1, bins)}
    return sorted(set(counted_quantiles(counts, [], feature, "n", at).select(*at).first()))


def grow_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, bins: int, classes: int, depth: int, tried: int, rng: np.random.Generator) -> np.ndarray:
    """Class shares (row, class) of the leaf of each row of bin numbers x, for a tree on rows of class y and weight w.

    Gini splits; every node tries `tried` features drawn anew. All nodes of a level are split at once from their histograms.
    """
    node, count, share = np.zeros(len(y), np.int64), 1, np.zeros((len(y), classes))
    live = np.arange(len(y))
    for level in range(depth + 1):
        total = np.bincount(node * classes + y[live], w[live], count * classes).reshape(count, classes)
        size = np.maximum(total.sum(axis=1), 1e-300)
        impurity = 1 - ((total / size[:, None]) ** 2).sum(axis=1)
        best, feature, at = np.zeros(count), np.zeros(count, np.int64), np.zeros(count, np.int64)
        if level < depth:
            drawn = np.argsort(rng.random((count, x.shape[1])), axis=1)[:, :tried]
            for f in range(x.shape[1]):
                h = np.bincount((node * bins + x[live, f]) * classes + y[live], w[live], count * bins * classes).reshape(count, bins, classes)
                low = np.cumsum(h, axis=1)[:, :-1]
                high = total[:, None] - low
                n, m = low.sum(axis=2), high.sum(axis=2)
                kept = (low**2).sum(axis=2) / np.maximum(n, 1e-300) + (high**2).sum(axis=2) / np.maximum(m, 1e-300)
                gain = np.where((n > 0) & (m > 0), impurity[:, None] - (1 - kept / size[:, None]), 0)
                gain[~(drawn == f).any(axis=1)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(count), k]
                better = top > best + 1e-12
                best[better], feature[better], at[better] = top[better], f, k[better]
        done = best[node] <= 0
        share[live[done]] = (total / size[:, None])[node[done]]
        live, node = live[~done], node[~done]
        if not len(live):
            break
        right = x[live, feature[node]] > at[node]
        _, node = np.unique(node * 2 + right, return_inverse=True)
        count = int(node.max()) + 1
    return share


def forest_confusion(
    rows: DataFrame, features: Sequence[str], label: str, trees: int = 200, depth: int = 10, seed: int = 1, bins: int = 32, most: int = 1_000_000
) -> DataFrame:
    """(label, prediction, n): a random forest trained on all rows, and how it sorts them. Labels are whole numbers from 0.

    Splits lie between at most `bins` bins a feature, so rows of the same bins and label are one cell with a count: n rows drawn with
    replacement weigh Poisson(n), as each row drawn for itself. The cells are counted once; tasks then grow a few trees each
    from all cells. With more than `most` cells, which no task should hold, the trees grow level by level over the rows instead.
    """
    from pyspark.ml.feature import Bucketizer

    features = list(features)
    known = lambda c: F.when(F.col(c).isNull() | F.isnan(c), F.raise_error(F.lit(f"{c} has missing values"))).otherwise(F.col(c)).alias(c)
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in (*features, label)]).select(*[known(c) for c in (*features, label)])
    cuts = [_thresholds(rows, c, bins) for c in features]
    cell = [f"__b{k}" for k in range(len(features))]
    finite = [[v for v in cs if math.isfinite(v)] or [0.0] for cs in cuts]  # any split does for a constant
    splits = [[-math.inf, *[math.nextafter(v, math.inf) for v in cs], math.inf] for cs in finite]  # a bin ends with its threshold
    binned = Bucketizer(splitsArray=splits, inputCols=features, outputCols=cell).transform(rows)
    cells = cut(binned.select(label, *[F.col(c).cast("int").alias(c) for c in cell]).groupBy(label, *cell).agg(F.count(F.lit(1)).alias("n")))
    n, top = cells.agg(F.count(F.lit(1)), F.max(label)).first()
    if not n:
        return rows.select(label).withColumn("prediction", F.col(label)).withColumn("n", F.lit(0).cast("long")).limit(0)
    if n > most:
        return _confusion_by_rows(rows, features, label, trees, depth, seed, bins)
    classes, tried, per = int(top) + 1, math.ceil(math.sqrt(len(features))), 4
    shares = [f"__p{k}" for k in range(classes)]

    def grow(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in (*cell, label)])  # draws do not depend on the order of arrival
        x = np.stack([t.column(c).to_numpy() for c in cell], axis=1).astype(np.int64)
        y, count = t.column(label).to_numpy().astype(np.int64), t.column("n").to_numpy()
        total = np.zeros((len(y), classes))
        for k in range(key[0].as_py() * per, min((key[0].as_py() + 1) * per, trees)):
            rng = np.random.default_rng([seed, k])
            total += grow_tree(x, y, rng.poisson(count).astype(float), bins, classes, depth, tried, rng)
        return pa.table({c: t.column(c) for c in (label, *cell, "n")} | {s: total[:, k] for k, s in enumerate(shares)})

    tasks = -(-trees // per)
    dealt = unfolded(cells).withColumn("__task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition(tasks, "__task")
    schema = f"`{label}` double, " + ", ".join(f"{c} int" for c in cell) + ", n long, " + ", ".join(f"{s} double" for s in shares)
    votes = dealt.groupBy("__task").applyInArrow(grow, schema).groupBy(label, *cell, "n").agg(*[F.round(F.sum(s), 9).alias(s) for s in shares])
    most_votes = F.array_position(F.array(*shares), F.greatest(*shares) if classes > 1 else F.col(shares[0])) - 1  # the smaller class on ties
    return votes.withColumn("prediction", most_votes.cast("double")).groupBy(label, "prediction").agg(F.sum("n").alias("n"))


def _confusion_by_rows(rows: DataFrame, features: Sequence[str], label: str, trees: int, depth: int, seed: int, bins: int) -> DataFrame:
    """`forest_confusion` with a pass over the rows for each group of nodes."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=list(features), outputCol="__v").transform(rows)
    model = RandomForestClassifier(featuresCol="__v", labelCol=label, numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed).fit(v)
    return model.transform(v).groupBy(label, "prediction").agg(F.count(F.lit(1)).alias("n"))
