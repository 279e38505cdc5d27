"""Object matching and segmentation scores built on the overlap table."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytomill.operators.ordered import join_on, quantiles, unfolded
from cytomill.session import cut

IMG = ("image_id",)
# fixed values: the threshold list of the dataset evaluation
STEPS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]


def strict_matches(pairs: DataFrame, thresholds: Sequence[float], img: Sequence[str] = IMG) -> DataFrame:
    """One-to-one matches for thresholds >= 0.5, without solving an assignment.

    Labels of a mask are disjoint, so above one half a partner is unique; at exactly one half an
    object may be split in two equal parts, and keeping the best per left then per right label is
    exact. Every window group has at most two rows.
    """
    if min(thresholds) < 0.5:
        raise ValueError("below 0.5 use assigned_pairs or greedy_matches")
    t = F.explode(F.array(*[F.lit(float(v)) for v in thresholds]))
    hit = pairs.where(F.col("iou") >= min(thresholds)).withColumn("threshold", t).where(F.col("iou") >= F.col("threshold"))
    wa = W.partitionBy(*img, "threshold", "a_label").orderBy(F.desc("iou"), "b_label")
    wb = W.partitionBy(*img, "threshold", "b_label").orderBy(F.desc("iou"), "a_label")
    return (
        hit.withColumn("__r", F.row_number().over(wa)).where("__r = 1")
        .withColumn("__r", F.row_number().over(wb)).where("__r = 1").drop("__r")
    )


def precision_table(
    pairs: DataFrame, n_true: DataFrame, n_pred: DataFrame, thresholds: Sequence[float] = (0.5, 0.75, 0.9), img: Sequence[str] = IMG
) -> DataFrame:
    """TP, FP, FN, AP (NULL when an image has neither truth nor prediction) per image and threshold.

    `n_true` / `n_pred` hold the image keys and a count; images missing on a side count as 0.
    """
    tp = strict_matches(pairs, thresholds, img).groupBy(*img, "threshold").agg(F.count(F.lit(1)).alias("tp"))
    t = F.explode(F.array(*[F.lit(float(v)) for v in thresholds]))
    every = n_true.select(*img).union(n_pred.select(*img)).distinct()
    every = join_on(join_on(every, n_true, img, "left"), n_pred, img, "left").fillna(0, ["n_true", "n_pred"])
    full = join_on(every.withColumn("threshold", t), tp, [*img, "threshold"], "left").fillna(0, ["tp"])
    fp, fn = F.col("n_pred") - F.col("tp"), F.col("n_true") - F.col("tp")
    return full.select(
        *img, "threshold", "n_true", "n_pred", "tp", fp.alias("fp"), fn.alias("fn"),
        (F.col("tp") / F.nullif(F.col("tp") + fp + fn, F.lit(0))).alias("ap"),
        F.coalesce(F.col("tp") / F.nullif(F.col("n_pred"), F.lit(0)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.col("tp") / F.nullif(F.col("n_true"), F.lit(0)), F.lit(0.0)).alias("recall"),
        F.coalesce(2 * F.col("tp") / F.nullif(F.col("n_pred") + F.col("n_true"), F.lit(0)), F.lit(0.0)).alias("f1"),
    )


def object_counts(runs: DataFrame, name: str, img: Sequence[str] = IMG) -> DataFrame:
    """Distinct non-background labels per image."""
    return runs.where(F.col("label") != 0).groupBy(*img).agg(F.countDistinct("label").alias(name))


def dataset_scores(table: DataFrame, by: Sequence[str], thresholds: Sequence[float] = (0.5, 0.75, 0.9)) -> DataFrame:
    """Mean AP per dataset at the chosen thresholds and their mean; empty images score 0."""
    t = table.where(F.col("threshold").isin([float(v) for v in thresholds]))
    per = t.groupBy(*by, "threshold").agg(F.avg(F.coalesce("ap", F.lit(0.0))).alias("ap"))
    name = {v: f"ap{int(round(v * 100))}" for v in thresholds}
    return per.groupBy(*by).agg(
        *[F.max(F.when(F.col("threshold") == float(v), F.col("ap"))).alias(n) for v, n in name.items()], F.avg("ap").alias("map")
    )


def segmentation_accuracy(table: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Per image mSA (mean AP over the ten steps), SA50, SA75 and precision/recall/F1 at 0.5."""
    at = lambda v, c: F.max(F.when(F.col("threshold") == v, F.col(c)))
    return table.groupBy(*img).agg(
        F.avg("ap").alias("msa"), at(0.5, "ap").alias("sa50"), at(0.75, "ap").alias("sa75"),
        at(0.5, "precision").alias("precision"), at(0.5, "recall").alias("recall"), at(0.5, "f1").alias("f1"),
    )


def unmatched(labels: DataFrame, matches: DataFrame, side: str, img: Sequence[str] = IMG) -> DataFrame:
    """Labels of one side (`a_label` or `b_label`) without a partner."""
    m = matches.select(*img, F.col(side).alias("label"))
    return join_on(labels.select(*img, "label").distinct(), m, [*img, "label"], "left_anti")


def outline_distances(matches: DataFrame, runs_a: DataFrame, runs_b: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Matches with the Hausdorff distance between the outlines of both objects, for any number of objects."""
    from cytomill.operators.masks import outline_pixels, run_pixels
    from cytomill.operators.spatial import contour_distances

    keys = [*img, "a_label", "b_label"]
    matches = unfolded(cut(matches))

    def outline(runs: DataFrame, side: str) -> DataFrame:
        px = outline_pixels(run_pixels(runs), img).withColumnRenamed("label", side)
        px = join_on(px, matches.select(*keys), [*img, side])
        return px.select(*keys, F.struct("y", "x").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    d = contour_distances(outline(runs_a, "a_label"), outline(runs_b, "b_label"), keys).select(*keys, "hausdorff")
    return join_on(matches, d, keys, "left")


def match_summary(matches: DataFrame, n_a: DataFrame, n_b: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Matched count, precision, recall, F1, mean and median IoU per image; 0 without matches.

    Matches that carry `hausdorff` (`outline_distances`) also give its mean, `mean_boundary_distance`.
    """
    means = {"iou": "mean_iou", "hausdorff": "mean_boundary_distance"}
    means = {c: name for c, name in means.items() if c in matches.columns}
    matches = unfolded(cut(matches))  # read by the means and by the median
    m = matches.groupBy(*img).agg(F.count(F.lit(1)).alias("matched"), *[F.avg(c).alias(name) for c, name in means.items()])
    m = join_on(m, quantiles(matches, img, "iou", {"median_iou": 0.5}), img, "left")
    t = join_on(join_on(n_a, n_b, img, "left"), m, img, "left").fillna(0, ["n_b", "matched"])
    p = F.coalesce(F.col("matched") / F.nullif(F.col("n_b"), F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("matched") / F.nullif(F.col("n_a"), F.lit(0)), F.lit(0.0))
    return t.select(
        *img, "n_a", "n_b", "matched", p.alias("precision"), r.alias("recall"),
        F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in (*means.values(), "median_iou")],
    )


def foreground_scores(overlap: DataFrame, by: Sequence[str] = IMG) -> DataFrame:
    """Foreground Dice and IoU from a contingency that includes background; both empty gives 1."""
    fa, fb = F.col("a_label") != 0, F.col("b_label") != 0
    s = overlap.groupBy(*by).agg(
        F.sum(F.when(fa & fb, F.col("n_px")).otherwise(0)).alias("both"),
        F.sum(F.when(fa, F.col("n_px")).otherwise(0)).alias("na"),
        F.sum(F.when(fb, F.col("n_px")).otherwise(0)).alias("nb"),
    )
    return s.select(
        *by,
        F.coalesce(2 * F.col("both") / F.nullif(F.col("na") + F.col("nb"), F.lit(0)), F.lit(1.0)).alias("dice"),
        F.coalesce(F.col("both") / F.nullif(F.col("na") + F.col("nb") - F.col("both"), F.lit(0)), F.lit(1.0)).alias("iou"),
    )


def _best_assignment(gain: np.ndarray) -> np.ndarray:
    """Column taken by each row of a rows <= cols gain matrix, by shortest augmenting paths."""
    n, m = gain.shape
    cost = gain.max() - gain
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        dist, prev, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, base = start, -1, 0.0
        while True:
            slack = base + cost[row] - u[row] - v
            better = ~done & (slack < dist)
            dist[better], prev[better] = slack[better], col
            col = int(np.argmin(np.where(done, np.inf, dist)))
            done[col], base = True, dist[col]
            if owner[col] < 0:
                break
            row = owner[col]
        u[start] += base
        seen = done & (owner >= 0)
        u[owner[seen]] += base - dist[seen]
        v[done] -= base - dist[done]
        while col >= 0:
            back = prev[col]
            owner[col] = owner[back] if back >= 0 else start
            col = back
    out = np.full(n, -1)
    for c, r in enumerate(owner):
        if r >= 0:
            out[r] = c
    return out


def assign_max(weights: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight one-to-one assignment of a dense matrix (small side decides)."""
    if weights.shape[0] <= weights.shape[1]:
        return [(r, int(c)) for r, c in enumerate(_best_assignment(weights))]
    return [(int(c), r) for r, c in enumerate(_best_assignment(weights.T))]


def _by_component(pairs: DataFrame, img: Sequence[str]) -> DataFrame:
    """Adds the connected component of the candidate graph, so that sequential or assignment rules run on
    small independent pieces, never on a whole image."""
    from cytomill.operators.graph import components

    p = cut(pairs).withColumn("__na", F.struct(*img, F.lit("a").alias("side"), F.col("a_label").alias("label"))).withColumn("__nb", F.struct(*img, F.lit("b").alias("side"), F.col("b_label").alias("label")))
    comp = components(p, None, "__na", "__nb").withColumnRenamed("node", "__na")
    return p.join(comp, "__na").drop("__na", "__nb")


def greedy_matches(pairs: DataFrame, threshold: float, img: Sequence[str] = IMG) -> DataFrame:
    """Ascending left label takes its best still-free partner (first on ties) when IoU >= threshold.

    The sequence is run as rounds: every left label asks for the best partner it has left; a right label keeps the smallest
    label that asks and will never take a larger one, so its pairs with larger labels go. When nothing goes any more, the pairs
    asked for are those of the sequence. A round moves pairs only; window groups are the partners of one object.
    """
    edges, n = cut(pairs.where(F.col("iou") >= threshold).select(*img, "a_label", "b_label", "iou")), None
    while True:
        best = W.partitionBy(*img, "a_label").orderBy(F.desc("iou"), "b_label")
        asked = edges.withColumn("__r", F.row_number().over(best))
        kept = asked.where("__r = 1").groupBy(*img, "b_label").agg(F.min("a_label").alias("__a"))
        left = join_on(asked, kept, [*img, "b_label"], "left").where("__a is null or a_label <= __a")
        left = cut(left.select(*img, "a_label", "b_label", "iou", "__r"))
        n, before = left.count(), edges.count() if n is None else n
        if n == before:
            return left.where("__r = 1").drop("__r")
        edges = left.drop("__r")


def _sparse_assignment(rows: np.ndarray, cols: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Positions of the pairs of a best one-to-one assignment; rows, cols are numbers from 0, rows ascending.

    Shortest augmenting paths over the listed pairs only. Each row may also stay alone (a column of its own without gain), so a
    search ends near where it starts and memory is that of the pairs.
    """
    n, m, top = int(rows[-1]) + 1, int(cols.max()) + 1, float(gain.max())
    first = np.searchsorted(rows, np.arange(n + 1)).tolist()
    cols, cost = cols.tolist(), (top - gain).tolist()
    u, v, owner, via = [0.0] * n, [0.0] * (m + n), [-1] * (m + n), [-1] * (m + n)
    for start in range(n):
        dist, prev, pair, done, heap = {}, {}, {}, {}, []
        row, col, base = start, -1, 0.0
        while True:
            offers = [(cols[k], cost[k], k) for k in range(first[row], first[row + 1])] + [(m + row, top, -1)]
            for c, price, k in offers:
                d = base + price - u[row] - v[c]
                if c not in done and d < dist.get(c, math.inf):
                    dist[c], prev[c], pair[c] = d, col, k
                    heapq.heappush(heap, (d, c))
            while heap[0][1] in done:
                heapq.heappop(heap)
            base, col = heapq.heappop(heap)
            done[col] = base
            if owner[col] < 0:
                break
            row = owner[col]
        u[start] += base
        for c, d in done.items():
            if owner[c] >= 0:
                u[owner[c]] += base - d
            v[c] -= base - d
        while col >= 0:
            back = prev[col]
            owner[col], via[col] = (owner[back] if back >= 0 else start), pair[col]
            col = back
    return np.array([k for c, k in enumerate(via) if c < m and owner[c] >= 0], dtype=np.int64)


def _settled(pairs: DataFrame, img: Sequence[str]) -> DataFrame:
    """Pairs that outweigh the best rivals on both their sides together, and so are in every best assignment.

    Exchanging such a pair for one rival on either side always loses. Window groups are the partners of one object.
    """
    wa = W.partitionBy(*img, "a_label").orderBy(F.desc("iou"), "b_label")
    wb = W.partitionBy(*img, "b_label").orderBy(F.desc("iou"), "a_label")
    rival = lambda w: F.coalesce(F.lead("iou").over(w), F.lit(0.0))
    p = pairs.withColumn("__ra", F.row_number().over(wa)).withColumn("__sa", rival(wa))
    p = p.withColumn("__rb", F.row_number().over(wb)).withColumn("__sb", rival(wb))
    return p.where("__ra = 1 and __rb = 1 and iou > __sa + __sb").select(*pairs.columns)


def _without(pairs: DataFrame, taken: DataFrame, img: Sequence[str]) -> DataFrame:
    """Pairs both of whose labels are still free."""
    for side in ("a_label", "b_label"):
        pairs = join_on(unfolded(pairs), taken.select(*img, side), [*img, side], "left_anti")
    return pairs


def assigned_pairs(pairs: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Best one-to-one assignment: most pairs with IoU >= 0.5 first, then the largest total IoU.

    Pairs above one half are forced. Of the rest, rounds of joins take every pair that is in all best assignments, which breaks
    large components up; what then still depends on each other is solved per component over its listed pairs.
    """
    cols = [*img, "a_label", "b_label", "iou", "n_px"]
    pairs = cut(pairs.select(*cols).where("n_px > 0"))
    sure = strict_matches(pairs, [0.5], img).select(*cols)
    rest = cut(_without(pairs, sure, img))
    while True:
        more = cut(_settled(rest, img))
        if more.isEmpty():
            break
        sure, rest = sure.unionByName(more), cut(_without(rest, more, img))
    schema = rest.schema

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a_label", "b_label"]).reset_index(drop=True)
        a, b = (np.unique(pdf[c], return_inverse=True)[1] for c in ("a_label", "b_label"))
        return pdf.loc[np.sort(_sparse_assignment(a, b, pdf["iou"].to_numpy(float))), schema.names]

    if rest.isEmpty():
        return sure
    return sure.unionByName(_by_component(rest, img).groupBy("component").applyInPandas(solve, schema))


def aggregated_jaccard(pairs: DataFrame, foreground: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Matched overlap over foreground union per image; `foreground` has columns union_px."""
    got = assigned_pairs(pairs, img).groupBy(*img).agg(F.sum("n_px").alias("hit"))
    return join_on(foreground, got, img, "left").select(
        *img, F.coalesce(F.col("hit") / F.nullif(F.col("union_px"), F.lit(0)), F.lit(0.0)).alias("aji")
    )


def boundary_scores(
    px_true: DataFrame, px_pred: DataFrame, scales: Sequence[float], height: int, width: int, exactly_one: bool = True, img: Sequence[str] = IMG,
    block: int = 256,
) -> DataFrame:
    """(image, scale, precision, recall, f) of outlines widened by a disk, per image and scale.

    The radius is scale x median diameter of the true objects, at least 1. Each image pixel counts the outline pixels of
    either side in its range, outlines mirrored at the image border. With `exactly_one`, as the published score does, a hit has one of both; a false
    pixel has one of one side and none of the other, so pixels with two or more of the other side are neither. Otherwise one means
    one or more. The image is cut into blocks, and each outline pixel goes to the blocks in its reach. There the disk is summed by
    rows: each outline pixel opens and closes one span per row, and the counts are running sums.
    """
    from cytomill.operators.masks import outline_pixels

    d = quantiles(px_true.groupBy(*img, "label").agg(F.sqrt(F.count(F.lit(1))).alias("s")), img, "s", {"m": 0.5})
    radii = [F.greatest(F.lit(1.0), F.lit(float(s)) * F.col("m") * (2 / math.sqrt(math.pi))).alias(f"__r{i}") for i, s in enumerate(scales)]
    rad = d.select(*img, *radii).withColumn("__r", F.greatest(F.lit(1.0), *[F.col(f"__r{i}") for i in range(len(scales))]))

    def sent(px: DataFrame, side: int) -> DataFrame:
        e = join_on(outline_pixels(px, img).select(*img, "y", "x").distinct(), rad, img)
        for c, size in (("y", height), ("x", width)):
            at = F.explode(F.array(F.col(c), -1 - F.col(c), 2 * size - 1 - F.col(c)))
            e = e.withColumn(c, at).where((F.col(c) >= -F.col("__r")) & (F.col(c) < size + F.col("__r")))
            first, last = (F.least(F.greatest(F.floor((F.col(c) + k * F.floor("__r")) / block), F.lit(0)), F.lit((size - 1) // block)) for k in (-1, 1))
            e = e.withColumn(f"__b{c}", F.explode(F.sequence(first, last)))
        return e.withColumn("__side", F.lit(side)).drop("__r")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = key[-2] * block, key[-1] * block
        h, w = min(block, height - y0), min(block, width - x0)
        y, x, side = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0, pdf["__side"].to_numpy()
        rows = []
        for i, scale in enumerate(scales):
            r = float(pdf[f"__r{i}"].iloc[0])
            steps = np.zeros((2, h, w + 1), np.int64)
            for dy in range(-math.floor(r), math.floor(r) + 1):
                half = math.floor(math.sqrt(r * r - dy * dy))
                a, b = np.maximum(x - half, 0), np.minimum(x + half + 1, w)
                ok = (y + dy >= 0) & (y + dy < h) & (a < b)
                line = ((side * h + y + dy) * (w + 1))[ok]
                steps += (np.bincount(line + a[ok], minlength=steps.size) - np.bincount(line + b[ok], minlength=steps.size)).reshape(steps.shape)
            t, p = np.cumsum(steps, axis=2)[:, :, :w]
            one_t, one_p = (t == 1, p == 1) if exactly_one else (t > 0, p > 0)
            rows.append((*key[:-2], float(scale), *(int(c.sum()) for c in (one_t & one_p, (t == 0) & one_p, one_t & (p == 0)))))
        return pd.DataFrame(rows, columns=[*img, "scale", "tp", "fp", "fn"])

    both = sent(px_true, 0).unionByName(sent(px_pred, 1))
    schema = ", ".join(f"`{k}` {px_true.schema[k].dataType.simpleString()}" for k in img) + ", scale double, tp long, fp long, fn long"
    c = both.groupBy(*img, "__by", "__bx").applyInPandas(run, schema)
    s = c.groupBy(*img, "scale").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    tp = F.col("tp")
    precision = F.coalesce(tp / F.nullif(tp + F.col("fp"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(tp / F.nullif(tp + F.col("fn"), F.lit(0)), F.lit(0.0))
    f = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    return s.select(*img, "scale", precision.alias("precision"), recall.alias("recall"), f.alias("f"))
