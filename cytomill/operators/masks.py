"""Label masks as run-length tables (image keys, y, x0, x1 exclusive, label) and pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytomill.operators.ordered import join_on, ordinal, unfolded

IMG = ("image_id",)


def run_pixels(runs: DataFrame) -> DataFrame:
    """Runs to one row per pixel; every other column is kept."""
    return unfolded(runs.withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1))).drop("x0", "x1"))


def pixel_runs(px: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Pixels to maximal runs. The window group is one image row of one label."""
    w = W.partitionBy(*img, "y", "label").orderBy("x")
    return (
        px.withColumn("__g", F.col("x") - F.row_number().over(w))
        .groupBy(*img, "y", "label", "__g")
        .agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
        .drop("__g")
    )


def areas(runs: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    return runs.groupBy(*img, "label").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("area"))


def pixel_areas(px: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    return px.groupBy(*img, "label").agg(F.count(F.lit(1)).alias("area"))


def centroids(runs: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    n = (F.col("x1") - F.col("x0")).cast("long")
    mid2 = (F.col("x0") + F.col("x1") - 1).cast("long")
    return runs.groupBy(*img, "label").agg(
        (F.sum(n * F.col("y")) / F.sum(n)).alias("cy"),
        (F.sum(n * mid2) / F.sum(n) / 2).alias("cx"),
        F.sum(n).alias("area"),
    )


def boxes(runs: DataFrame, img: Sequence[str] = IMG, origin_y: Column | None = None, origin_x: Column | None = None) -> DataFrame:
    """Half-open boxes (y0, x0, y1, x1), optionally moved to global coordinates by a block origin."""
    oy, ox = origin_y if origin_y is not None else F.lit(0), origin_x if origin_x is not None else F.lit(0)
    return runs.groupBy(*img, "label").agg(
        F.min(F.col("y") + oy).alias("y0"),
        F.min(F.col("x0") + ox).alias("x0"),
        (F.max(F.col("y") + oy) + 1).alias("y1"),
        F.max(F.col("x1") + ox).alias("x1"),
    )


def inclusive_boxes(runs: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    b = boxes(runs, img)
    return b.withColumn("y1", F.col("y1") - 1).withColumn("x1", F.col("x1") - 1)


def merge_boxes(b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of the boxes that share an id."""
    return b.groupBy(*keys).agg(
        F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("y1").alias("y1"), F.max("x1").alias("x1")
    )


def relabel(runs: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Labels 1..K per image in ascending old label. Only the distinct labels are ranked."""
    labels = runs.select(*img, "label").distinct()
    new = ordinal(labels, img, "label", "__new").drop("__new_of")
    return join_on(runs, new, [*img, "label"]).withColumn("label", F.col("__new").cast("long")).drop("__new")


def filter_by_area(
    runs: DataFrame, img: Sequence[str] = IMG, min_size: int = 15, max_size: Column | int | None = None, renumber: bool = True
) -> DataFrame:
    """Keeps objects with min_size <= area <= max_size and renumbers the rest 1..K."""
    a = areas(runs, img).where(F.col("area") >= min_size)
    if max_size is not None:
        a = a.where(F.col("area") <= max_size)
    kept = join_on(runs, a.drop("area"), [*img, "label"], "left_semi")
    return relabel(kept, img) if renumber else kept


def drop_edge_objects(runs: DataFrame, height: Column | int, width: Column | int, img: Sequence[str] = IMG) -> DataFrame:
    """Removes objects whose box touches an image edge."""
    b = boxes(runs, img).where(
        (F.col("y0") <= 0) | (F.col("x0") <= 0) | (F.col("y1") >= height) | (F.col("x1") >= width)
    )
    return join_on(runs, b.select(*img, "label"), [*img, "label"], "left_anti")


def filter_extent(objects: DataFrame, keys: Sequence[str], axis: str, minimum: int) -> DataFrame:
    """Drops objects that span fewer than `minimum` slices or frames."""
    long_enough = (
        objects.groupBy(*keys).agg((F.max(axis) - F.min(axis) + 1).alias("__e")).where(F.col("__e") >= minimum).drop("__e")
    )
    return join_on(objects, long_enough, list(keys), "left_semi")


def filter_images_by_objects(runs: DataFrame, minimum: int, img: Sequence[str] = IMG) -> DataFrame:
    """Objects per image with their mean diameter (floored at 5), images below the minimum left out."""
    diam = areas(runs, img).withColumn("d", 2 * F.sqrt(F.col("area") / F.pi()))
    return (
        diam.groupBy(*img)
        .agg(F.count(F.lit(1)).alias("n_objects"), F.greatest(F.avg("d"), F.lit(5.0)).alias("diameter"))
        .where(F.col("n_objects") >= minimum)
    )


def neighbour_counts(px: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Per pixel, how many of its 4 neighbours carry the same label (one shuffle)."""
    spots = F.array(
        *[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(own).alias("own"))
          for dy, dx, own in ((0, 0, 1), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0))]
    )
    sent = px.select(*img, "y", "x", "label", F.explode(spots).alias("s"))
    return (
        sent.groupBy(*img, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "label")
        .agg(F.max("s.own").alias("__own"), F.sum(1 - F.col("s.own")).alias("same4"))
        .where(F.col("__own") == 1)
        .drop("__own")
    )


def outline_pixels(px: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Label pixels with at least one 4-neighbour of another label or background."""
    return neighbour_counts(px, img).where(F.col("same4") < 4).drop("same4")


def perimeters(px: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Contour length from boundary-pixel patterns.

    A boundary pixel counts 1 for each boundary 4-neighbour pair direction and sqrt(2) for
    diagonal-only steps, halved over both ends; the usual approximation of a traced contour.
    """
    edge = outline_pixels(px, img)
    steps = F.array(
        *[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(k).alias("k"))
          for dy, dx, k in ((0, 0, 0), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1), (1, 1, 2), (1, -1, 2), (-1, 1, 2), (-1, -1, 2))]
    )
    sent = edge.select(*img, "y", "x", "label", F.explode(steps).alias("s"))
    near = (
        sent.groupBy(*img, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "label")
        .agg(
            F.max(F.when(F.col("s.k") == 0, 1).otherwise(0)).alias("own"),
            F.sum(F.when(F.col("s.k") == 1, 1).otherwise(0)).alias("straight"),
            F.sum(F.when(F.col("s.k") == 2, 1).otherwise(0)).alias("diagonal"),
        )
        .where(F.col("own") == 1)
    )
    diag = F.greatest(F.lit(0), F.least(F.col("diagonal"), 2 - F.col("straight")))
    length = F.least(F.col("straight"), F.lit(2)) / 2 + diag * F.lit(2.0 ** 0.5) / 2
    return near.groupBy(*img, "label").agg(F.sum(length).alias("perimeter"))


def moment_shapes(runs: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Area, centroid, extent, axis lengths, eccentricity and orientation from run moments."""
    n = (F.col("x1") - F.col("x0")).cast("double")
    a, b = F.col("x0").cast("double"), (F.col("x1") - 1).cast("double")
    y = F.col("y").cast("double")
    sx = (a + b) * n / 2
    sxx = (b * (b + 1) * (2 * b + 1) - (a - 1) * a * (2 * a - 1)) / 6
    m = runs.groupBy(*img, "label").agg(
        F.sum(n).alias("n"), F.sum(n * y).alias("sy"), F.sum(sx).alias("sx"), F.sum(n * y * y).alias("syy"),
        F.sum(sxx).alias("sxx"), F.sum(sx * y).alias("sxy"),
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
    )
    m = m.withColumn("cy", F.col("sy") / F.col("n")).withColumn("cx", F.col("sx") / F.col("n"))
    m = (
        m.withColumn("uyy", F.col("syy") / F.col("n") - F.col("cy") * F.col("cy") + 1 / 12)
        .withColumn("uxx", F.col("sxx") / F.col("n") - F.col("cx") * F.col("cx") + 1 / 12)
        .withColumn("uxy", F.col("sxy") / F.col("n") - F.col("cx") * F.col("cy"))
    )
    root = F.sqrt((F.col("uxx") - F.col("uyy")) * (F.col("uxx") - F.col("uyy")) + 4 * F.col("uxy") * F.col("uxy"))
    m = m.withColumn("l1", (F.col("uxx") + F.col("uyy") + root) / 2).withColumn(
        "l2", F.greatest((F.col("uxx") + F.col("uyy") - root) / 2, F.lit(0.0))
    )
    return m.select(
        *img, "label",
        F.col("n").cast("long").alias("area"), "cy", "cx",
        (F.col("n") / ((F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0")))).alias("extent"),
        (4 * F.sqrt("l1")).alias("major_axis"), (4 * F.sqrt("l2")).alias("minor_axis"),
        F.sqrt(1 - F.col("l2") / F.col("l1")).alias("eccentricity"),
        (0.5 * F.atan2(2 * F.col("uxy"), F.col("uyy") - F.col("uxx"))).alias("orientation"),
        (2 * F.sqrt(F.col("n") / F.pi())).alias("equivalent_diameter"),
    )


def _hull_area(pdf: pd.DataFrame, cols: list[str]) -> pd.DataFrame:
    """Convex hull area of one object from the outer corners of its rows."""
    pts = sorted(
        {(float(x), float(y) + d) for y, lo, hi in zip(pdf["y"], pdf["lo"], pdf["hi"]) for x in (lo, hi) for d in (0.0, 1.0)}
    )

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(pts[::-1])
    area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])) / 2
    first = pdf.iloc[0]
    return pd.DataFrame([[*[first[c] for c in cols], abs(area)]], columns=[*cols, "hull_area"])


def hull_areas(runs: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Convex hull area per object; the Python side sees two points per object row."""
    rows = runs.groupBy(*img, "label", "y").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    cols = [*img, "label"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in cols) + ", hull_area double"
    return rows.groupBy(*cols).applyInPandas(lambda pdf: _hull_area(pdf, cols), schema)


def solidity(runs: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    a, h = areas(runs, img), hull_areas(runs, img)
    return join_on(a, h, [*img, "label"]).withColumn("solidity", F.col("area") / F.col("hull_area"))


def dilate(px: DataFrame, rounds: int, img: Sequence[str] = IMG) -> DataFrame:
    """Grows labels into background by 4-neighbour steps; the larger label wins a contested pixel."""
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(own).alias("own"))
                       for dy, dx, own in ((0, 0, 1), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0))])
    for _ in range(rounds):
        sent = px.select(*img, "y", "x", "label", F.explode(around).alias("s"))
        px = (
            sent.groupBy(*img, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
            .agg(F.max(F.when(F.col("s.own") == 1, F.col("label"))).alias("__own"), F.max("label").alias("__new"))
            .select(*img, "y", "x", F.coalesce("__own", "__new").alias("label"))
        )
    return px


def distance_to_outline(px: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Squared distance of each pixel to its object's outline, exact and separable.

    Step 1 takes, along each column of the object, the distance to the nearest outline pixel
    (two running windows); step 2 reads min over the row of (dx^2 + step1^2) off the lower envelope of
    the row's parabolas, in time linear in the row. Each row of an object is gathered once.
    """
    n = neighbour_counts(px, img).withColumn("e", F.col("same4") < 4)
    col = W.partitionBy(*img, "label", "x").orderBy("y")
    up = F.last(F.when(F.col("e"), F.col("y")), True).over(col.rowsBetween(W.unboundedPreceding, 0))
    down = F.first(F.when(F.col("e"), F.col("y")), True).over(col.rowsBetween(0, W.unboundedFollowing))
    g = n.withColumn("g", F.least(F.col("y") - up, down - F.col("y")))
    rows = g.groupBy(*img, "label", "y").agg(F.sort_array(F.collect_list(F.struct("x", "g"))).alias("r"))

    def lowest(at: list[int], high: list[int]) -> list[int]:
        top, starts = [], []  # parabolas of the envelope and where each one begins to be lowest
        for i, x in enumerate(at):
            while top:
                j = top[-1]
                # first whole place where parabola i is lower than parabola j
                s = ((x * x + high[i] ** 2) - (at[j] * at[j] + high[j] ** 2)) // (2 * (x - at[j])) + 1
                if s > starts[-1]:
                    break
                top.pop()
                starts.pop()
            starts.append(s if top else at[0])
            top.append(i)
        out, k = [], 0
        for x in at:
            while k + 1 < len(top) and starts[k + 1] <= x:
                k += 1
            out.append((x - at[top[k]]) ** 2 + high[top[k]] ** 2)
        return out

    @F.pandas_udf("array<long>")
    def envelopes(at: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([lowest(a.tolist(), h.tolist()) for a, h in zip(at, high)])

    near = rows.select(*img, "label", "y", "r.x", envelopes(F.col("r.x"), F.col("r.g")).alias("dist2"))
    return near.select(*img, "label", "y", F.inline(F.arrays_zip("x", "dist2")))


def deepest_pixels(px: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """The interior pixel farthest from the outline (first in y, x order on ties)."""
    d = distance_to_outline(px, img)
    best = F.max_by(F.struct("y", "x"), F.struct(F.col("dist2"), -F.col("y"), -F.col("x")))
    return d.groupBy(*img, "label").agg(best.alias("p"), F.max("dist2").alias("dist2")).select(
        *img, "label", F.col("p.y").alias("y"), F.col("p.x").alias("x"), "dist2"
    )


def one_hot(runs: DataFrame, ids: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Selected labels as channel numbers 0..K-1 with their pixels (sparse indicator stack)."""
    kept = join_on(runs, ids.select(*img, "label").distinct(), [*img, "label"], "left_semi")
    return run_pixels(relabel(kept, img)).withColumn("channel", F.col("label") - 1).drop("label")


def rle_column_major(px: DataFrame, height: int, width: int, img: Sequence[str] = IMG) -> DataFrame:
    """Column-major run lengths per object, starting with the zero run (0 if the first pixel is set)."""
    p = px.select(*img, "label", (F.col("x").cast("long") * height + F.col("y")).alias("p"))
    w = W.partitionBy(*img, "label").orderBy("p")
    isl = p.withColumn("g", F.col("p") - F.row_number().over(w))
    runs = isl.groupBy(*img, "label", "g").agg(F.min("p").alias("s"), (F.max("p") + 1).alias("e"))
    prev = F.coalesce(F.lag("e").over(W.partitionBy(*img, "label").orderBy("s")), F.lit(0))
    runs = runs.withColumn("zeros", F.col("s") - prev).withColumn("ones", F.col("e") - F.col("s"))
    packed = runs.groupBy(*img, "label").agg(
        F.sort_array(F.collect_list(F.struct("s", "zeros", "ones"))).alias("r"), F.max("e").alias("last")
    )
    flat = F.flatten(F.transform("r", lambda t: F.array(t.zeros, t.ones)))
    tail = F.lit(height * width) - F.col("last")
    return packed.select(
        *img, "label", F.when(tail > 0, F.concat(flat, F.array(tail))).otherwise(flat).alias("counts")
    )
