"""Nearest neighbours and spatial statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytomill.functions import tails
from cytomill.operators.ordered import attach, join_on, unfolded
from cytomill.session import cut


#: Levels of halving that doubles can tell apart, and levels that a crowded or far cell is opened at a time.
FINEST, STEP = 48, 3


def _around(index, size, own):
    """(smallest, largest) distance along an axis between a query cell and a cell of `size` query cells, with a cell to spare
    for rounding."""
    start, stop = index * size, (index + 1) * size
    gap = F.greatest(start - own - 2, own - 1 - stop, F.lit(0.0))
    return gap, F.greatest(F.abs(stop - own), F.abs(own + 1 - start)) + 1


def _opened(asked: DataFrame, counts: DataFrame, keys: Sequence[str], top: int, k: int, most: int) -> DataFrame:
    """Cells that can hold answers of far or crowded query cells: (keys, fx, fy, lv, cx, cy).

    Cells of more than `most` points are replaced by the smaller ones inside them, a few levels a round. Before each round the
    cells of a query cell are ordered by their largest distance; k points surely lie within the distance at which their counts reach k,
    and cells that begin beyond it go. What stays is a rim of small cells, however far the query lies from the points.
    """
    own = [*keys, "fx", "fy"]
    while True:
        size = F.pow(F.lit(2.0), F.lit(top) - F.col("lv"))
        gx, wx = _around(F.col("cx"), size, F.col("fx"))
        gy, wy = _around(F.col("cy"), size, F.col("fy"))
        near = asked.withColumn("__gap", gx * gx + gy * gy).withColumn("__wide", wx * wx + wy * wy)
        upto = F.sum("n").over(W.partitionBy(*own).orderBy("__wide"))
        near = near.withColumn("__upto", upto)
        reach = F.min(F.when(F.col("__upto") >= k, F.col("__wide"))).over(W.partitionBy(*own))
        near = near.withColumn("__reach", reach).where(F.col("__reach").isNull() | (F.col("__gap") <= F.col("__reach") * (1 + 1e-9)))
        asked = unfolded(cut(near.select(*own, "lv", "cx", "cy", "n")))
        full = (F.col("n") > most) & (F.col("lv") < top)
        if not asked.where(full).take(1):
            return asked.drop("n")
        deeper = F.least(F.lit(STEP), F.lit(top) - F.col("lv"))
        side = F.sequence(F.lit(0), F.pow(F.lit(2.0), deeper).cast("int") - 1)
        inner = asked.where(full).select(*own, "lv", "cx", "cy", F.explode(side).alias("__a")).withColumn("__b", F.explode(side))
        grown = F.pow(F.lit(2.0), deeper).cast("long")
        inner = inner.select(
            *own, (F.col("lv") + deeper).alias("lv"), (F.col("cx") * grown + F.col("__a")).alias("cx"), (F.col("cy") * grown + F.col("__b")).alias("cy")
        )
        asked = asked.where(~full).unionByName(join_on(unfolded(inner), counts, [*keys, "lv", "cx", "cy"]))


def candidates(query: DataFrame, data: DataFrame, k: int, keys: Sequence[str] = (), x: str = "x", y: str = "y", id: str = "id") -> DataFrame:
    """(keys, qx, qy, d2, dst): every query place with the data points of all cells that can hold its k nearest.

    Each query cell searches at the finest level of halving cells where it holds k points itself: their distance bounds
    the answer, so two rings around it are enough. Where these rings hold far more points, as for outliers next to a dense region,
    the cells are opened and pruned by distance (`_opened`). Cells go as deep as `FINEST` when one at the usual depth is crowded, so a few
    far coordinates do not put the rest into one cell. Equal coordinates are searched once, with the k smallest ids of a spot.
    """
    keys = list(keys)
    spots_q = query.select(*keys, F.col(x).alias("qx"), F.col(y).alias("qy")).distinct()
    first = W.partitionBy(*keys, x, y).orderBy(id)
    spots = (
        data.select(*keys, x, y, id).withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k)
        .groupBy(*keys, F.col(x).alias("dx"), F.col(y).alias("dy")).agg(F.sort_array(F.collect_list(id)).alias("ids"))
    )
    ext = query.select(x, y).union(data.select(x, y)).agg(
        F.min(x), F.max(x), F.min(y), F.max(y), F.count(F.lit(1))
    ).first()
    top, x0, y0, side = 1, 0.0, 0.0, 1.0
    if ext[4]:
        x0, y0 = float(ext[0]), float(ext[2])
        side = max(float(ext[1]) - x0, float(ext[3]) - y0, 1e-9) * (1 + 1e-9)
        top = min(24, max(1, math.ceil(math.log(max(ext[4], 2), 4)) + 4))
    deepest = lambda c, low: F.floor((F.col(c) - low) / side * 2.0**FINEST).cast("long")
    spots = unfolded(cut(spots.withColumn("fx", deepest("dx", x0)).withColumn("fy", deepest("dy", y0))))
    spots_q = unfolded(cut(spots_q.withColumn("fx", deepest("qx", x0)).withColumn("fy", deepest("qy", y0))))
    most = max(4 * k, 64)
    at = lambda c: F.shiftright(c, FINEST - top)
    crowd = spots.groupBy(*keys, at("fx"), at("fy")).agg(F.sum(F.size("ids")).alias("n")).agg(F.max("n")).first()[0]
    if crowd is not None and crowd > 16 * most:
        top = FINEST
    spots, spots_q = (d.withColumn("fx", at("fx")).withColumn("fy", at("fy")) for d in (spots, spots_q))
    up = F.explode(F.sequence(F.lit(0), F.lit(top)))

    def at_levels(cells: DataFrame) -> DataFrame:
        c = cells.withColumn("lv", up)
        higher = lambda v: F.call_function("shiftright", F.col(v), F.lit(top) - F.col("lv"))
        return c.withColumn("cx", higher("fx")).withColumn("cy", higher("fy"))

    fine = spots.groupBy(*keys, "fx", "fy").agg(F.sum(F.size("ids")).alias("n"))
    counts = unfolded(cut(at_levels(fine).groupBy(*keys, "lv", "cx", "cy").agg(F.sum("n").alias("n"))))
    enough = counts.where((F.col("n") >= k) | (F.col("lv") == 0)).select(*keys, "lv", "cx", "cy")
    cells_q = at_levels(spots_q.select(*keys, "fx", "fy").distinct())
    level = (
        join_on(cells_q, enough, [*keys, "lv", "cx", "cy"]).groupBy(*keys, "fx", "fy").agg(F.max("lv").alias("lv"))
    )
    higher = lambda v: F.call_function("shiftright", F.col(v), F.lit(top) - F.col("lv"))
    ring = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3)])
    asked = level.withColumn("cx", higher("fx")).withColumn("cy", higher("fy")).select(*keys, "fx", "fy", "lv", F.explode(ring).alias("o"), "cx", "cy").select(
        *keys, "fx", "fy", "lv", (F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy")
    )
    asked = unfolded(cut(join_on(unfolded(asked), counts, [*keys, "lv", "cx", "cy"])))
    hard = asked.groupBy(*keys, "fx", "fy").agg(F.sum("n").alias("__n")).where(F.col("__n") > 16 * most).drop("__n")
    hard = unfolded(cut(hard))
    if hard.take(1):
        far = _opened(join_on(asked, hard, [*keys, "fx", "fy"], "left_semi"), counts, keys, top, k, most)
        asked = unfolded(join_on(asked, hard, [*keys, "fx", "fy"], "left_anti").drop("n").unionByName(far))
    else:
        asked = asked.drop("n")
    wanted = asked.select(*keys, "lv", "cx", "cy").distinct()
    holders = join_on(at_levels(fine.select(*keys, "fx", "fy")), wanted, [*keys, "lv", "cx", "cy"], "left_semi")
    there = join_on(spots, holders, [*keys, "fx", "fy"]).select(*keys, "lv", "cx", "cy", "dx", "dy", "ids")
    here = join_on(spots_q, asked, [*keys, "fx", "fy"]).select(*keys, "lv", "cx", "cy", "qx", "qy")
    d2 = (F.col("qx") - F.col("dx")) * (F.col("qx") - F.col("dx")) + (F.col("qy") - F.col("dy")) * (F.col("qy") - F.col("dy"))
    return join_on(unfolded(here), there, [*keys, "lv", "cx", "cy"]).select(*keys, "qx", "qy", d2.alias("d2"), F.explode("ids").alias("dst"))


def nearest(query: DataFrame, data: DataFrame, k: int, keys: Sequence[str] = (), x: str = "x", y: str = "y", id: str = "id") -> DataFrame:
    """The k data points nearest to every query point within equal keys: (keys, src, dst, dist, rank).

    Exact; the rows that are compared (`candidates`) grow with the points, wherever they lie. Ties go to the smaller id.
    """
    keys = list(keys)
    best = W.partitionBy(*keys, "qx", "qy").orderBy("d2", "dst")
    found = candidates(query, data, k, keys, x, y, id).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    q = query.select(*keys, F.col(x).alias("qx"), F.col(y).alias("qy"), F.col(id).alias("src"))
    return join_on(q, unfolded(found), [*keys, "qx", "qy"]).select(*keys, "src", "dst", F.sqrt("d2").alias("dist"), "rank")


def knn_edges(points: DataFrame, k: int, x: str = "x", y: str = "y", id: str = "id") -> DataFrame:
    """(src, dst, dist): k nearest other points of every point (all others when there are fewer).

    A point is left out of its own list by id, so equal coordinates do no harm.
    """
    near = nearest(points, points, k + 1, (), x, y, id).where(F.col("src") != F.col("dst"))
    w = W.partitionBy("src").orderBy("dist", "dst")
    edges = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "dst", "dist")
    return cut(edges)  # a graph is read many times after this


def _gathered_distances(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`contour_distances` of outlines that fit an array each: every point is moved once, and all pairs are compared."""
    side = lambda k: F.collect_list(F.when(F.col("dir") == k, F.struct("x", "y")))
    held = points.groupBy(*keys).agg(side(0).alias("__a"), side(1).alias("__b")).where((F.size("__a") > 0) & (F.size("__b") > 0))

    @F.pandas_udf("average double, hausdorff double")
    def compare(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for places in parts:
            got = np.empty((len(places[0]), 2))
            for i, (ax, ay, bx, by) in enumerate(zip(*places, strict=True)):
                d2 = np.square(np.subtract.outer(ax, bx)) + np.square(np.subtract.outer(ay, by))
                d = np.sqrt(np.concatenate((d2.min(axis=1), d2.min(axis=0))))
                got[i] = d.mean(), d.max()
            yield pd.DataFrame(got, columns=["average", "hausdorff"])

    return held.select(*keys, compare("__a.x", "__a.y", "__b.x", "__b.y").alias("__d")).select(*keys, "__d.average", "__d.hausdorff")


def _searched_distances(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`contour_distances` by the exact neighbour search, for outlines of any length."""
    a, b = (points.where(F.col("dir") == k).select(*keys, F.struct("x", "y").alias("id"), "x", "y") for k in (0, 1))
    ab = nearest(a, b, 1, keys).select(*keys, "dist", F.lit(0).alias("dir"))
    ba = nearest(b, a, 1, keys).select(*keys, "dist", F.lit(1).alias("dir"))
    return ab.unionByName(ba).groupBy(*keys).agg(F.avg("dist").alias("average"), F.max("dist").alias("hausdorff"))


def contour_distances(a: DataFrame, b: DataFrame, keys: Sequence[str], most: int = 1_000) -> DataFrame:
    """Average nearest distance over both directions and the Hausdorff distance per key; inputs (keys, x, y).

    Two outlines of at most `most` points together are gathered and compared in one row. Longer ones, found by a count beforehand, go
    through the neighbour search, so that no task holds all their pairs. Both give the same numbers.
    """
    keys = list(keys)
    known = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in (*keys, "x", "y")])  # NULL matches nothing
    place = lambda d, k: d.where(known).select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(k).alias("dir"))
    points = unfolded(cut(place(a, 0).unionByName(place(b, 1))))
    if not keys:
        return _searched_distances(points, keys)
    large = unfolded(cut(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).drop("__n")))
    if large.isEmpty():
        return _gathered_distances(points, keys)
    small = _gathered_distances(join_on(points, large, keys, "left_anti"), keys)
    return small.unionByName(_searched_distances(join_on(points, large, keys, "left_semi"), keys))


def morans_i(expr: DataFrame, edges: DataFrame, cells: DataFrame, cell: str = "cell_id", gene: str = "gene", value: str = "cnt", textbook: bool = False) -> DataFrame:
    """I, expectation, variance, z, p per gene with a non-zero sum, from non-zero entries only.

    Zeros are implicit: cross products are expanded around the mean, so only pairs of expressing
    neighbours are joined. `textbook` uses the squared form of S1.
    """
    v = F.col(value).cast("double")
    out_deg = edges.groupBy("src").agg(F.count(F.lit(1)).alias("od")).withColumnRenamed("src", cell)
    in_deg = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("idg")).withColumnRenamed("dst", cell)
    e = expr.select(cell, gene, v.alias("v"))
    withdeg = e.join(out_deg, cell, "left").join(in_deg, cell, "left").fillna(0, ["od", "idg"])
    m = withdeg.groupBy(gene).agg(
        F.sum("v").alias("s1x"), F.sum(F.pow("v", 2)).alias("s2x"), F.sum(F.pow("v", 3)).alias("s3x"), F.sum(F.pow("v", 4)).alias("s4x"),
        F.sum(F.col("od") * F.col("v")).alias("so"), F.sum(F.col("idg") * F.col("v")).alias("si"),
    ).where("s1x <> 0")
    src = e.select(F.col(cell).alias("src"), gene, F.col("v").alias("vi"))
    dst = e.select(F.col(cell).alias("dst"), gene, F.col("v").alias("vj"))
    cross = edges.select("src", "dst").join(src, "src").join(dst, ["dst", gene]).groupBy(gene).agg(F.sum(F.col("vi") * F.col("vj")).alias("sij"))
    rows = out_deg.agg(F.sum("od").alias("w"), F.sum(F.col("od") * F.col("od")).alias("row2"))
    if textbook:
        both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        s1 = both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c")).agg((0.5 * F.sum(F.col("c") * F.col("c"))).alias("S1"))
        deg = out_deg.join(in_deg, cell, "full").fillna(0, ["od", "idg"])
        rows = rows.drop("row2").transform(attach, deg.agg(F.sum(F.pow(F.col("od") + F.col("idg"), 2)).alias("row2"))).transform(attach, s1)
    else:
        rows = rows.withColumn("S1", F.col("w").cast("double"))
    one = rows.transform(attach, cells.agg(F.count(F.lit(1)).cast("double").alias("n")))
    j = m.join(cross, gene, "left").fillna(0.0, ["sij"]).transform(attach, one)
    n, w, mean = F.col("n"), F.col("w").cast("double"), F.col("s1x") / F.col("n")
    zz = F.col("s2x") - n * mean * mean
    z4 = F.col("s4x") - 4 * mean * F.col("s3x") + 6 * mean * mean * F.col("s2x") - 4 * mean * mean * mean * F.col("s1x") + n * F.pow(mean, F.lit(4.0))
    top = n * (F.col("sij") - mean * (F.col("so") + F.col("si")) + w * mean * mean)
    j = j.select(gene, "n", w.alias("w"), F.col("row2").cast("double").alias("S2"), "S1", zz.alias("zz"), z4.alias("z4"), top.alias("top"))
    flat = F.abs(F.col("zz")) < 1e-9
    i = F.when(flat, F.lit(0.0)).otherwise(F.col("top") / F.nullif(F.col("w") * F.col("zz"), F.lit(0.0)))
    expected = -1.0 / (F.col("n") - 1)
    b2 = F.coalesce((F.col("z4") / F.col("n")) / F.nullif(F.pow(F.col("zz") / F.col("n"), F.lit(2.0)), F.lit(0.0)), F.lit(1.0))
    nn, ww, s1c, s2c = F.col("n"), F.col("w"), F.col("S1"), F.col("S2")
    var = (
        nn * ((nn * nn - 3 * nn + 3) * s1c - nn * s2c + 3 * ww * ww) - b2 * ((nn * nn - nn) * s1c - 2 * nn * s2c + 6 * ww * ww)
    ) / ((nn - 1) * (nn - 2) * (nn - 3) * ww * ww) - expected * expected
    out = j.select(gene, i.alias("morans_i"), expected.alias("expected_i"), var.alias("variance"), flat.alias("__flat"))
    z = F.when(F.col("__flat") | (F.col("variance") <= 0), F.lit(0.0)).otherwise((F.col("morans_i") - F.col("expected_i")) / F.sqrt(F.greatest("variance", F.lit(1e-300))))
    return out.withColumn("z_score", z).withColumn("p_value", tails.normal_two_sided("z_score")).drop("__flat")


def getis_ord(values: DataFrame, edges: DataFrame, id: str = "id", value: str = "value") -> DataFrame:
    """Gi* z score of every cell, itself included in its neighbourhood; no spread gives 0."""
    v = values.select(F.col(id).alias("dst"), F.col(value).cast("double").alias("v"))
    both = edges.select("src", "dst").unionByName(values.select(F.col(id).alias("src"), F.col(id).alias("dst")))
    local = both.join(v, "dst").groupBy("src").agg(F.sum("v").alias("s"), F.count(F.lit(1)).cast("double").alias("wi"))
    g = values.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(value).alias("m"), F.var_pop(F.col(value).cast("double")).alias("s2"))
    j = local.transform(attach, g)
    var = F.col("s2") * ((F.col("n") * F.col("wi") - F.col("wi") * F.col("wi")) / F.nullif(F.col("n") - 1, F.lit(0.0)))
    gi = (F.col("s") - F.col("m") * F.col("wi")) / F.sqrt(F.when(var <= 0, F.lit(1e-10)).otherwise(var))
    return j.select(F.col("src").alias(id), F.when(F.col("s2") == 0, F.lit(0.0)).otherwise(gi).alias("gi_star"))


def spatially_variable(moran: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Significant genes in order of p, then falling I."""
    return moran.where(F.col("p_value") < alpha).orderBy("p_value", F.desc("morans_i"), "gene")
