"""Shape columns of label masks and the joined feature table with one wide row per object."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomill.operators import pixels
from cytomill.operators.masks import areas
from cytomill.operators.ordered import join_on, unfolded
from cytomill.session import cut

IMG = ("image_id",)
#: Length of a boundary pixel by its (straight, diagonal) boundary neighbours; other patterns count nothing.
STEP = {
    **dict.fromkeys([(2, 0), (3, 0), (2, 1), (3, 1), (2, 2), (3, 2)], 1.0),
    **dict.fromkeys([(0, 2), (1, 3)], math.sqrt(2)),
    **dict.fromkeys([(1, 1), (1, 2)], (1 + math.sqrt(2)) / 2),
}
STEP_TABLE = np.array([[STEP.get((s, d), 0.0) for d in range(5)] for s in range(5)])
_MEASURED = (
    "area long, cy double, cx double, uyy double, uxx double, uxy double, box_area long, perimeter double, convex_area long, feret double, euler long"
)


def _sides(y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Left and right side of the convex hull of the pixels' edge midpoints, in half pixels by rising line; each
    row gives its outermost pixels only."""

    def side(x: np.ndarray, sign: int) -> list[tuple[int, int]]:
        # per line the outermost point: a pixel reaches half a pixel out on its own line, and its middle on the lines next to it
        out: list[tuple[int, int]] = []
        at: dict[int, int] = {}
        for row, edge in zip((2 * y).tolist(), (sign * 2 * x).tolist(), strict=True):
            for line, far in ((row - 1, edge), (row, edge + 1), (row + 1, edge)):
                at[line] = max(far, at.get(line, far))
        for line in sorted(at):
            p = (line, at[line])
            while len(out) > 1 and (out[-1][1] - out[-2][1]) * (p[0] - out[-1][0]) <= (p[1] - out[-1][1]) * (out[-1][0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    return [(a, -b) for a, b in side(lo, -1)], side(hi, 1)


def _convex_area(left: list[tuple[int, int]], right: list[tuple[int, int]]) -> int:
    """Pixels whose centre lies in the hull, counted line by line in whole numbers."""

    def ends(side: list[tuple[int, int]], up: bool) -> dict[int, int]:
        out = {}
        for (ya, xa), (yb, xb) in zip(side, side[1:], strict=False):
            for line in range(ya + ya % 2, yb + 1, 2):
                whole, den = xa * (yb - ya) + (xb - xa) * (line - ya), 2 * (yb - ya)
                out[line] = -(-whole // den) if up else whole // den
        return out

    first, last = ends(left, True), ends(right, False)
    return sum(last[line] - first[line] + 1 for line in first)


def _widest(points: list[tuple[int, int]]) -> float:
    """Largest distance between hull corners, by calipers around the ring."""
    ring = list(dict.fromkeys(points))
    if len(ring) < 3:
        return max((math.dist(p, q) for p in ring for q in ring), default=0.0) / 2
    best, j, n = 0, 1, len(ring)
    for i in range(n):
        a, b = ring[i], ring[(i + 1) % n]
        while True:
            p, q = ring[j % n], ring[(j + 1) % n]
            best = max(best, *((u[0] - v[0]) ** 2 + (u[1] - v[1]) ** 2 for u in (a, b) for v in (p, q)))
            if (b[0] - a[0]) * (q[1] - p[1]) - (b[1] - a[1]) * (q[0] - p[0]) <= 0:
                break
            j += 1
    return math.sqrt(best) / 2


def _perimeter(y: np.ndarray, a: np.ndarray, b: np.ndarray, strip: int = 1 << 20) -> float:
    """Sum of STEP over boundary pixels, drawn in strips of about `strip` pixels with two rows of overlap."""
    top, x_min, width = int(y.min()), int(a.min()), int(b.max() - a.min()) + 4
    height, total, rows = int(y.max()) - top + 1, 0.0, max(1, strip // width)
    order = np.argsort(y, kind="stable")
    y, a, b = y[order] - top, a[order] - x_min + 2, b[order] - x_min + 2
    for at in range(0, height, rows):
        stop = min(at + rows, height)
        first, last = np.searchsorted(y, [at - 2, stop + 2])
        steps = np.zeros((stop - at + 4, width + 1), np.int8)
        np.add.at(steps, (y[first:last] - at + 2, a[first:last]), 1)
        np.add.at(steps, (y[first:last] - at + 2, b[first:last]), -1)
        inside = np.cumsum(steps, axis=1)[:, :width] > 0
        edge = np.zeros_like(inside)
        m = inside[1:-1, 1:-1]
        edge[1:-1, 1:-1] = m & ~(inside[:-2, 1:-1] & inside[2:, 1:-1] & inside[1:-1, :-2] & inside[1:-1, 2:])
        e = edge.astype(np.int8)
        straight = e[1:-3, 2:-2] + e[3:-1, 2:-2] + e[2:-2, 1:-3] + e[2:-2, 3:-1]
        diagonal = e[1:-3, 1:-3] + e[1:-3, 3:-1] + e[3:-1, 1:-3] + e[3:-1, 3:-1]
        counted = np.bincount((straight * 5 + diagonal)[edge[2:-2, 2:-2]].ravel(), minlength=25)
        total += float(counted @ STEP_TABLE.ravel())
    return total


def _measured(rows) -> tuple:
    """Sums, hull, perimeter and Euler number of one object from its runs (y, x0, x1 exclusive)."""
    y, a, b = np.array([(r["y"], r["x0"], r["x1"]) for r in rows], np.int64).T
    order = np.lexsort((a, y))
    y, a, b = y[order], a[order], b[order]
    joined = np.flatnonzero((np.diff(y) == 0) & (b[:-1] == a[1:]))  # runs that touch on their row are one
    if len(joined):
        heads = np.setdiff1d(np.arange(len(y)), joined + 1)
        y, a, b = y[heads], a[heads], np.maximum.reduceat(b, heads)
    y0, x0 = int(y.min()), int(a.min())
    n, v, lo, hi = b - a, y - y0, a - x0, b - x0 - 1
    whole = lambda c: int(c.sum())
    count, sy, sx2 = whole(n), whole(n * v), whole(n * (lo + hi))
    syy, sxy2 = whole(n * v * v), whole(n * v * (lo + hi))
    sxx6 = whole(hi * (hi + 1) * (2 * hi + 1) - (lo - 1) * lo * (2 * lo - 1))
    uyy = (count * syy - sy * sy) / count**2
    uxx = (2 * count * sxx6 - 3 * sx2 * sx2) / (12 * count**2)
    uxy = (count * sxy2 - sy * sx2) / (2 * count**2)
    heads = np.flatnonzero(np.diff(y, prepend=y[0] - 1))
    left, right = _sides(y[heads], a[heads], np.maximum.reduceat(b, heads) - 1)
    # runs minus touching pairs of neighbouring rows: both unions of closed squares, and rows have no triple meetings
    start, stop = np.searchsorted(y, y + 1), np.searchsorted(y, y + 2)
    touching = sum(
        int(((a[s:e] <= hi_) & (lo_ <= b[s:e])).sum()) for s, e, lo_, hi_ in zip(start.tolist(), stop.tolist(), a.tolist(), b.tolist(), strict=True)
    )
    box = (int(y.max()) - y0 + 1) * int(b.max() - x0)
    return (
        count, y0 + sy / count, x0 + sx2 / (2 * count), uyy, uxx, uxy, box, _perimeter(y, a, b),
        _convex_area(left, right), _widest(left + right[::-1]), len(y) - touching,
    )


def _measure(column: str) -> Column:
    """Struct of the measures of an array of runs."""
    names = [c.split()[0] for c in _MEASURED.split(", ")]

    @F.pandas_udf(_MEASURED)
    def run(objects: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in objects:
            yield pd.DataFrame([_measured(rows) for rows in batch], columns=names)

    return run(column)


def shape_features(runs: DataFrame, img: Sequence[str] = IMG, exact: bool = False) -> DataFrame:
    """The thirteen shape columns of each object, with its centroid.

    Perimeter by boundary patterns, solidity from the pixels in the convex hull, form factor equal to the uncapped compactness. As
    published, the largest Feret diameter is the longer axis and the Euler number 1; with `exact` they are measured: the
    hull's widest distance, and parts minus holes (8-neighbours). One shuffle of the runs; the runs of an object meet, its pixels
    do not, and the perimeter is drawn in strips of bounded size. Runs of one object must not overlap.
    """
    m = runs.groupBy(*img, "label").agg(F.collect_list(F.struct("y", "x0", "x1")).alias("r"))
    m = m.select(*img, "label", _measure("r").alias("m")).select(*img, "label", "m.*")
    uyy, uxx, uxy = F.col("uyy"), F.col("uxx"), F.col("uxy")
    root = F.sqrt((uxx - uyy) * (uxx - uyy) + 4 * uxy * uxy)
    m = m.withColumn("l1", (uxx + uyy + root) / 2).withColumn("l2", F.greatest((uxx + uyy - root) / 2, F.lit(0.0)))
    compact = F.when(F.col("perimeter") > 0, 4 * math.pi * F.col("area") / F.nullif(F.col("perimeter") * F.col("perimeter"), F.lit(0.0))).otherwise(0.0)
    diagonal = F.when(uxy > 0, math.pi / 4).otherwise(-math.pi / 4)
    return m.select(
        *img, "label", "area", "perimeter", F.when(F.col("l1") > 0, F.sqrt(1 - F.col("l2") / F.nullif("l1", F.lit(0.0)))).otherwise(0.0).alias("eccentricity"),
        (F.col("area") / F.col("convex_area")).alias("solidity"), (F.col("area") / F.col("box_area")).alias("extent"),
        (4 * F.sqrt("l1")).alias("major_axis_length"), (4 * F.sqrt("l2")).alias("minor_axis_length"),
        F.when(uxx == uyy, diagonal).otherwise(0.5 * F.atan2(2 * uxy, uyy - uxx)).alias("orientation"),
        F.sqrt(4 * F.col("area") / math.pi).alias("equivalent_diameter"), compact.alias("compactness"), compact.alias("form_factor"),
        (F.col("feret") if exact else 4 * F.sqrt("l1")).alias("max_feret_diameter"),
        (F.col("euler") if exact else F.lit(1).cast("long")).alias("euler_number"), "cy", "cx",
    )


def _wide(long: DataFrame, keys: Sequence[str], by: str, values: Sequence[str | int], columns: dict[str, str], name: str) -> DataFrame:
    """One row per key; `name` is a pattern over (column title, value)."""
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col(by) == v, F.col(c))).alias(name.format(title, v)) for v in values for c, title in columns.items()
    ])


SHAPE = {
    "area": "Area", "perimeter": "Perimeter", "eccentricity": "Eccentricity", "solidity": "Solidity", "extent": "Extent",
    "major_axis_length": "MajorAxisLength", "minor_axis_length": "MinorAxisLength", "orientation": "Orientation",
    "equivalent_diameter": "EquivalentDiameter", "compactness": "Compactness", "form_factor": "FormFactor",
    "max_feret_diameter": "MaxFeretDiameter", "euler_number": "EulerNumber",
}
INTENSITY = {"mean": "Mean", "std": "Std", "min": "Min", "max": "Max", "total": "IntegratedIntensity", "range": "Range"}
EDGE = {"mean_edge": "MeanEdge", "std_edge": "StdEdge"}
QUANTILES = {"lower_quartile": "LowerQuartile", "median": "Median", "mad": "MAD", "upper_quartile": "UpperQuartile"}
#: Titles of the texture statistics.
TEXTURE = {
    "angular_second_moment": "AngularSecondMoment", "contrast": "Contrast", "correlation": "Correlation", "variance": "Variance",
    "inverse_difference_moment": "InverseDifferenceMoment", "sum_average": "SumAverage", "sum_variance": "SumVariance",
    "sum_entropy": "SumEntropy", "entropy": "Entropy", "difference_variance": "DifferenceVariance", "difference_entropy": "DifferenceEntropy",
    "info_measure_1": "InfoMeas1", "info_measure_2": "InfoMeas2",
}
CORRELATION = {"pearson": "Pearson", "manders1": "Manders1", "manders2": "Manders2", "overlap": "Overlap"}


def field_features(
    runs: DataFrame, image: DataFrame, channels: Sequence[str], nucleus: str, img: Sequence[str] = IMG, scales: Sequence[int] = (8,),
    spectrum: int = 5, bins: int = 4,
) -> DataFrame:
    """One wide row per object (image, cell_id): shape, intensity, location, texture, granularity, radial and correlation columns.

    `runs` is the mask (image, y, x0, x1, label), `image` the pixels (image, y, x, channels) of whole images, background too. Texture
    is taken at every distance of `scales` in every channel, granularity in the nucleus channel only. The families are
    computed per object and meet in joins on (image, label), rows of one object each. The image is moved once, to be cut into blocks; the
    pixels of the objects' boxes, with the openings and the edges, are stored (`pixels.object_pixels`), and all families read these.
    """
    keys = [*img, "label"]
    stored = pixels.object_pixels(runs.select(*img, "y", "x0", "x1", "label"), image, channels, nucleus, pixels.opening_sizes(spectrum), img)
    box = unfolded(cut(stored))
    inside = box.where("__in")
    shape = shape_features(runs, img)
    out = shape.select(
        *keys, *[F.col(c).alias(f"Cell_AreaShape_{title}") for c, title in SHAPE.items()],
        F.col("cx").alias("Cell_Location_Center_X"), F.col("cy").alias("Cell_Location_Center_Y"),
    )
    families = [
        _wide(pixels.intensity_stats(inside, channels, img), keys, "channel", channels, INTENSITY, "Cell_Intensity_{}_{}"),
        _wide(_edges(inside.where("__edge"), channels, img), keys, "channel", channels, EDGE, "Cell_Intensity_{}_{}"),
        _wide(pixels.intensity_quantiles(inside, channels, img), keys, "channel", channels, QUANTILES, "Cell_Intensity_{}_{}"),
    ]
    sizes = areas(runs, img)
    for c in channels:
        grey = pixels.grey_levels(inside, c, box=box, img=img)
        for s in scales:
            texture = pixels.haralick(pixels.cooccurrence(grey, s, img), sizes, img=img)
            families.append(texture.select(*keys, *[F.col(k).alias(f"Cell_Texture_{title}_{c}_s{s}") for k, title in TEXTURE.items()]))
    grain = pixels.opened_spectrum(inside, nucleus, spectrum, img)
    families.append(_wide(grain, keys, "scale", range(1, spectrum + 1), {"granularity": "Granularity"}, "Cell_{}_{}_" + nucleus))
    rings = {f"bin{b}": f"Bin{b}" for b in range(1, bins + 1)}
    families.append(_wide(pixels.radial_distribution(inside, channels, bins, img), keys, "channel", channels, rings, "Cell_RadialDistribution_{1}_{0}"))
    if len(channels) > 1:
        pairs = pixels.channel_correlations(inside, channels, img).withColumn("pair", F.concat_ws("_", "a", "b"))
        families.append(_wide(pairs, keys, "pair", [f"{a}_{b}" for a, b in combinations(channels, 2)], CORRELATION, "Cell_Correlation_{}_{}"))
    for family in families:
        out = join_on(out, family, keys, "left")
    return out.withColumnRenamed("label", "cell_id")


def _edges(px: DataFrame, channels: Sequence[str], img: Sequence[str]) -> DataFrame:
    """Statistics of the boundary pixels, which carry their label, so that masks may overlap."""
    keys = [*img, "label"]
    return px.select(*keys, *channels).unpivot(keys, list(channels), "channel", "v").groupBy(*keys, "channel").agg(
        F.avg("v").alias("mean_edge"), F.stddev_pop("v").alias("std_edge")
    )
