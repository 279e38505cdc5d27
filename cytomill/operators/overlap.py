"""Region joins: points in runs, runs on runs, boxes on boxes. All are equi joins on an image row and
a coarse x bin, with the exact test as a residual condition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytomill.operators.ordered import join_on, unfolded

IMG = ("image_id",)


def _binned(runs: DataFrame, size: int, lo: str = "x0", hi: str = "x1") -> DataFrame:
    span = F.sequence(F.floor(F.col(lo) / size), F.floor((F.col(hi) - 1) / size))
    return unfolded(runs.withColumn("__bx", F.explode(span)))


def place_points(points: DataFrame, mode: str, height: Column | int, width: Column | int, y: str = "y", x: str = "x") -> DataFrame:
    """`clip` moves outside points to the border, `drop` removes them."""
    if mode == "clip":
        h = height if isinstance(height, Column) else F.lit(height)
        w = width if isinstance(width, Column) else F.lit(width)
        return points.withColumn(y, F.greatest(F.lit(0), F.least(F.col(y), h - 1))).withColumn(
            x, F.greatest(F.lit(0), F.least(F.col(x), w - 1))
        )
    return points.where((F.col(y) >= 0) & (F.col(y) < height) & (F.col(x) >= 0) & (F.col(x) < width))


def assign_points(points: DataFrame, runs: DataFrame, img: Sequence[str] = IMG, size: int = 64) -> DataFrame:
    """Label of the run under each point, 0 where there is none (columns y, x)."""
    r = _binned(runs.select(*img, F.col("y").alias("__y"), "x0", "x1", "label"), size)
    for k in img:
        r = r.withColumnRenamed(k, f"__r_{k}")
    p = points.withColumn("__px", F.floor(F.col("x") / size))
    cond = (F.col("y") == F.col("__y")) & (F.col("__px") == F.col("__bx")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    for k in img:
        cond = cond & (F.col(k) == F.col(f"__r_{k}"))
    return (
        p.join(r, cond, "left")
        .withColumn("label", F.coalesce("label", F.lit(0)).cast("long"))
        .drop("__px", "__y", "__bx", "x0", "x1", *[f"__r_{k}" for k in img])
    )


def hit_labels(points: DataFrame, runs: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Labels holding at least one point."""
    spots = points.select(*img, "y", "x").distinct()
    return assign_points(spots, runs, img).where(F.col("label") != 0).select(*img, "label").distinct()


def unassigned_fraction(points: DataFrame, runs: DataFrame, height: int, width: int, img: Sequence[str] = IMG) -> DataFrame:
    """Share of in-bounds points outside every region, per image; points are counted per pixel first."""
    spots = place_points(points, "drop", height, width).groupBy(*img, "y", "x").agg(F.count(F.lit(1)).alias("n"))
    got = assign_points(spots, runs, img)
    inside = got.groupBy(*img).agg(
        F.sum("n").alias("n_points"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n_outside")
    )
    every = points.select(*img).distinct()
    return join_on(every, inside, img, "left").select(
        *img,
        F.coalesce("n_points", F.lit(0)).alias("n_points"),
        F.coalesce(F.col("n_outside") / F.col("n_points"), F.lit(0.0)).alias("unassigned_fraction"),
    )


def overlap_from_pairs(df: DataFrame, img: Sequence[str], a: str, b: str) -> DataFrame:
    """Contingency of two labelings that sit on the same rows, background included."""
    return df.groupBy(*img, F.col(a).cast("long").alias("a_label"), F.col(b).cast("long").alias("b_label")).agg(
        F.count(F.lit(1)).alias("n_px")
    )


def common_runs(a: DataFrame, b: DataFrame, img: Sequence[str] = IMG, size: int = 64) -> DataFrame:
    """(image, y, a_label, b_label, x0, x1): where runs of two tables cover the same pixels, cut at bin borders."""
    left = _binned(a.select(*img, "y", "x0", "x1", F.col("label").alias("a_label")), size)
    right = _binned(b.select(*img, "y", F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("label").alias("b_label")), size, "u0", "u1")
    lo = F.greatest("x0", "u0", F.col("__bx") * size)
    hi = F.least("x1", "u1", (F.col("__bx") + 1) * size)
    return left.join(right, [*img, "y", "__bx"]).where(hi > lo).select(*img, "y", "a_label", "b_label", lo.alias("x0"), hi.alias("x1"))


def run_overlap(a: DataFrame, b: DataFrame, img: Sequence[str] = IMG, size: int = 64) -> DataFrame:
    """Foreground pixel co-occurrence of two run tables; overlaps are cut at bin borders so they sum once."""
    return common_runs(a, b, img, size).groupBy(*img, "a_label", "b_label").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("n_px"))


def uncovered_runs(spans: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x0, x1): the parts of each span that no run with the same keys covers; one span a key, runs lie within it."""
    ends = spans.select(*keys, F.explode(F.array("x0", "x1")).alias("x0")).withColumn("x1", F.col("x0"))
    before = W.partitionBy(*keys).orderBy("x0").rowsBetween(W.unboundedPreceding, -1)  # the runs of one row
    gaps = runs.select(*keys, "x0", "x1").unionByName(ends).withColumn("__x", F.max("x1").over(before)).where(F.col("__x") < F.col("x0"))
    return gaps.select(*keys, F.col("__x").alias("x0"), F.col("x0").alias("x1"))


def iou_pairs(overlap: DataFrame, img: Sequence[str] = IMG, area_a: DataFrame | None = None, area_b: DataFrame | None = None) -> DataFrame:
    """Overlap table to IoU. Areas default to the margins of the table, which must then hold background."""
    if area_a is None:
        area_a = overlap.groupBy(*img, "a_label").agg(F.sum("n_px").alias("area_a"))
    if area_b is None:
        area_b = overlap.groupBy(*img, "b_label").agg(F.sum("n_px").alias("area_b"))
    o = overlap.where((F.col("a_label") != 0) & (F.col("b_label") != 0))
    o = join_on(join_on(o, area_a, [*img, "a_label"]), area_b, [*img, "b_label"])
    union = F.col("area_a") + F.col("area_b") - F.col("n_px")
    return o.withColumn("iou", F.coalesce(F.col("n_px") / F.nullif(union, F.lit(0)), F.lit(0.0)))


def box_pairs(boxes: DataFrame, img: Sequence[str] = IMG, size: int = 64) -> DataFrame:
    """Pairs i < j of boxes with a positive common area; each pair is found in exactly one grid bin."""
    def spread(tag: str) -> DataFrame:
        b = boxes.select(*img, *[F.col(c).alias(f"{c}{tag}") for c in ("label", "y0", "x0", "y1", "x1")])
        by = F.sequence(F.floor(F.col(f"y0{tag}") / size), F.floor((F.col(f"y1{tag}") - 1) / size))
        bx = F.sequence(F.floor(F.col(f"x0{tag}") / size), F.floor((F.col(f"x1{tag}") - 1) / size))
        return unfolded(b.withColumn("__by", F.explode(by)).withColumn("__bx", F.explode(bx)))

    top, left = F.greatest("y0_i", "y0_j"), F.greatest("x0_i", "x0_j")
    bottom, right = F.least("y1_i", "y1_j"), F.least("x1_i", "x1_j")
    return (
        spread("_i").join(spread("_j"), [*img, "__by", "__bx"])
        .where((F.col("label_i") < F.col("label_j")) & (bottom > top) & (right > left))
        .where((F.floor(top / size) == F.col("__by")) & (F.floor(left / size) == F.col("__bx")))
        .select(*img, F.col("label_i").alias("i"), F.col("label_j").alias("j"), ((bottom - top) * (right - left)).cast("long").alias("box_overlap"))
    )


def self_overlaps(runs: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """IoU and intersection-over-minimum for every overlapping pair i < j of candidate masks."""
    from cytomill.operators.masks import areas

    o = run_overlap(runs, runs, img).where(F.col("a_label") < F.col("b_label"))
    a = unfolded(areas(runs, img))
    p = iou_pairs(o, img, a.withColumnsRenamed({"label": "a_label", "area": "area_a"}), a.withColumnsRenamed({"label": "b_label", "area": "area_b"}))
    return p.withColumn("iomin", F.col("n_px") / F.least("area_a", "area_b")).withColumnsRenamed({"a_label": "i", "b_label": "j"})


def consecutive_overlap(runs: DataFrame, img: Sequence[str] = IMG, axis: str = "z") -> DataFrame:
    """Overlap between slice s (a) and slice s+1 (b), with areas and IoU."""
    from cytomill.operators.masks import areas

    keys = [*img, axis]
    upper = runs.withColumn(axis, F.col(axis) - 1)
    o = run_overlap(runs, upper, keys)
    a = areas(runs, keys).withColumnsRenamed({"label": "a_label", "area": "area_a"})
    b = areas(upper, keys).withColumnsRenamed({"label": "b_label", "area": "area_b"})
    return iou_pairs(o, keys, a, b)
