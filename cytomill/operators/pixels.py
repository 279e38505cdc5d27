"""Per-object intensity features and per-image rescaling from pixel tables (image, y, x, label, channels)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytomill.operators.ordered import group_starts, join_on, median_mad_columns, pearson, quantiles, spread, unfolded, whole_groups
from cytomill.session import cut

IMG = ("image_id",)


def intensity_stats(px: DataFrame, channels: Sequence[str], img: Sequence[str] = IMG) -> DataFrame:
    """Mean, std, min, max, sum, range per object and channel (long)."""
    long = px.select(*img, "label", *channels).unpivot([*img, "label"], list(channels), "channel", "v")
    return long.groupBy(*img, "label", "channel").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.sum("v").alias("total"), (F.max("v") - F.min("v")).alias("range"),
    )


def edge_intensity(px: DataFrame, channels: Sequence[str], img: Sequence[str] = IMG) -> DataFrame:
    """Mean and std over the inner boundary pixels."""
    from cytomill.operators.masks import outline_pixels

    e = join_on(px, outline_pixels(px.select(*img, "y", "x", "label"), img).select(*img, "y", "x"), [*img, "y", "x"], "left_semi")
    long = e.select(*img, "label", *channels).unpivot([*img, "label"], list(channels), "channel", "v")
    return long.groupBy(*img, "label", "channel").agg(F.avg("v").alias("mean_edge"), F.stddev_pop("v").alias("std_edge"))


def intensity_quantiles(px: DataFrame, channels: Sequence[str], img: Sequence[str] = IMG) -> DataFrame:
    """Quartiles, median and MAD per object and channel."""
    keys = [*img, "label"]
    mm = median_mad_columns(px, keys, channels).withColumnRenamed("feature", "channel")
    long = px.select(*keys, *channels).unpivot(keys, list(channels), "channel", "v")
    q = quantiles(long, [*keys, "channel"], "v", {"lower_quartile": 0.25, "upper_quartile": 0.75})
    return join_on(mm, q, [*keys, "channel"])


def radial_distribution(px: DataFrame, channels: Sequence[str], bins: int = 4, img: Sequence[str] = IMG) -> DataFrame:
    """Share of an object's intensity per ring of normalised distance from its centroid; total <= 0 gives 0."""
    keys = [*img, "label"]
    c = px.groupBy(*keys).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    d = join_on(px, c, keys).withColumn("d", F.sqrt((F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx"))))
    far = d.groupBy(*keys).agg(F.max("d").alias("far"))
    d = join_on(d, far, keys).withColumn("bin", F.least(F.floor(F.col("d") / F.when(F.col("far") > 0, F.col("far")).otherwise(F.lit(1.0)) * bins), F.lit(bins - 1)).cast("long"))
    long = d.select(*keys, "bin", *channels).unpivot([*keys, "bin"], list(channels), "channel", "v")
    total = F.sum("v")
    per = long.groupBy(*keys, "channel").agg(total.alias("t"), *[F.sum(F.when(F.col("bin") == b, F.col("v")).otherwise(0.0)).alias(f"s{b}") for b in range(bins)])
    return per.select(*keys, "channel", *[F.when(F.col("t") > 0, F.col(f"s{b}") / F.nullif("t", F.lit(0.0))).otherwise(F.lit(0.0)).alias(f"bin{b + 1}") for b in range(bins)])


def channel_correlations(px: DataFrame, channels: Sequence[str], img: Sequence[str] = IMG, min_pixels: int = 3) -> DataFrame:
    """Pearson, two overlap ratios and the overlap coefficient per object and channel pair."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for a, b in combinations(channels, 2):
        x, y = F.col(a), F.col(b)
        aggs += [pearson(x, y).alias(f"r_{a}_{b}"), F.sum(x * y).alias(f"d_{a}_{b}")]
    aggs += [F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in channels]
    g = px.groupBy(*img, "label").agg(*aggs)
    rows = []
    for a, b in combinations(channels, 2):
        d, qa, qb = F.col(f"d_{a}_{b}"), F.col(f"q_{a}"), F.col(f"q_{b}")
        ok = (F.col("n") >= min_pixels) & (qa > 0) & (qb > 0)

        def safe(c: Column, ok=ok) -> Column:
            return F.coalesce(F.when(ok, c), F.lit(0.0))

        z = lambda c: F.nullif(c, F.lit(0.0))
        rows.append(F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.when(F.col("n") >= min_pixels, F.col(f"r_{a}_{b}")), F.lit(0.0)).alias("pearson"),
            safe(d / z(qa)).alias("manders1"), safe(d / z(qb)).alias("manders2"), safe(d / z(F.sqrt(qa * qb))).alias("overlap"),
        ))
    return g.select(*img, "label", F.inline(F.array(*rows)))


def box_pixels(runs: DataFrame, image: DataFrame, channels: Sequence[str], img: Sequence[str] = IMG) -> DataFrame:
    """(image, label, y, x, channels) for every image pixel inside the bounding box of an object, whatever it belongs to."""
    from cytomill.operators.masks import boxes

    b = spread(boxes(runs, img), img).withColumn("y", F.explode(F.sequence("y0", F.col("y1") - 1))).withColumn("x", F.explode(F.sequence("x0", F.col("x1") - 1)))
    return join_on(unfolded(b.select(*img, "label", "y", "x")), image.select(*img, "y", "x", *channels), [*img, "y", "x"])


def grey_levels(px: DataFrame, channel: str, levels: int = 256, box: DataFrame | None = None, img: Sequence[str] = IMG) -> DataFrame:
    """Channel of object pixels rescaled to 0..levels-1 (truncated) over the object's bounding box (rows of `box` in any order, as from
    `box_pixels`), or over the object itself without it."""
    keys = [*img, "label"]
    e = (px if box is None else box).groupBy(*keys).agg(F.min(channel).alias("lo"), F.max(channel).alias("hi"))
    j = join_on(px.select(*keys, "y", "x", channel), e, keys)
    g = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(channel) - F.col("lo")) * (levels - 1) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))).otherwise(F.lit(0))
    return j.select(*keys, "y", "x", g.cast("long").alias("g"))


def _pair_counts(t: pa.Table, keys: Sequence[str], distance: int, band: int) -> pa.Table:
    """Counts of `cooccurrence` for whole groups of (keys, __band), rows in this order."""
    starts = group_starts(t, [*keys, "__band"])
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
    y, x, own = (t.column(c).to_numpy() for c in ("y", "x", "__band"))
    own = np.flatnonzero(y // band == own)  # the others came as partners only
    levels, g = np.unique(t.column("g").to_numpy(), return_inverse=True)
    y, x = y - np.minimum.reduceat(y, starts)[group], x - np.minimum.reduceat(x, starts)[group]
    height, width = int(y.max()) + 1 + distance, int(x.max()) + 1 + 2 * distance
    place = lambda r, dy, dx: (group[r] * height + y[r] + dy) * width + x[r] + distance + dx
    at = place(slice(None), 0, 0)
    order = np.argsort(at, kind="stable")
    at, rows = at[order], []
    for k, (dy, dx) in enumerate(((0, distance), (distance, distance), (distance, 0), (distance, -distance))):
        to = place(own, dy, dx)
        first = np.searchsorted(at, to)
        n = np.searchsorted(at, to, "right") - first
        src = np.repeat(own, n)
        dst = order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(src))]
        rows += [np.stack([group[src], np.full(len(src), k), g[i], g[j]]) for i, j in ((src, dst), (dst, src))]
    group, direction, i, j = np.concatenate(rows, axis=1)
    code, n = np.unique(((group * 4 + direction) * len(levels) + i) * len(levels) + j, return_counts=True)
    code, j = np.divmod(code, len(levels))
    code, i = np.divmod(code, len(levels))
    group, direction = np.divmod(code, 4)
    named = {k: t.column(k).take(pa.array(starts[group])) for k in keys}
    return pa.table(named | {"direction": direction, "i": levels[i], "j": levels[j], "n": n.astype(np.int64)})


def cooccurrence(grey: DataFrame, distance: int = 8, img: Sequence[str] = IMG, band: int = 64) -> DataFrame:
    """Grey-level pair counts (direction, i, j, n) inside objects, both orders counted, level 0 ignored.

    Each pixel is moved once, to the band of `band` rows of its object (and to the one before, if it can be a partner there). There
    the pairs are found in arrays, in row batches that end with a band, so that a task holds a batch and a band.
    """
    keys = [*img, "label"]
    schema = ", ".join(f"`{k}` {grey.schema[k].dataType.simpleString()}" for k in keys) + ", direction long, i long, j long, n long"
    whole = [F.col(c).cast("long").alias(c) for c in ("y", "x", "g")]
    bands = F.explode(F.array_distinct(F.array(*[F.floor(c / band) for c in (F.col("y"), F.col("y") - distance)])))
    sent = grey.where("g <> 0").na.drop(subset=[*keys, "y", "x"]).select(*keys, *whole).withColumn("__band", bands)
    sent = sent.repartition(*keys, "__band").sortWithinPartitions(*keys, "__band")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, [*keys, "__band"]):
            yield from _pair_counts(t, keys, distance, band).to_batches()

    return sent.mapInArrow(run, schema).groupBy(*keys, "direction", "i", "j").agg(F.sum("n").alias("n"))


def haralick(glcm: DataFrame, objects: DataFrame, min_pixels: int = 30, directions: int = 4, img: Sequence[str] = IMG) -> DataFrame:
    """Thirteen texture statistics for every object of `objects` (image, label, area), averaged over the directions.

    All are 0 for objects of fewer than `min_pixels` pixels and for those without pairs in one of the directions.

    Everything is a sum over counts n with total t, e.g. entropy = log2 t - sum(n log2 n) / t. The
    table is symmetric, so both margins are equal and both cross entropies are twice the margin's.
    Groups are one object's co-occurrence table, bounded by the grey levels.
    """
    keys = [*img, "label", "direction"]
    glcm = cut(glcm).repartition(*img, "label")  # read by two aggregates, which need no other shuffle of the counts
    i, j, n = F.col("i").cast("double"), F.col("j").cast("double"), F.col("n").cast("double")
    base = glcm.groupBy(*keys).agg(
        F.sum(n).alias("t"), F.sum(n * n).alias("nn"), F.sum(n * F.log2(n)).alias("nl"), F.sum(i * j * n).alias("ij"),
        F.sum(n / (1 + (i - j) * (i - j))).alias("idm"),
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("long").alias("k")) for k, v in (("m", i), ("s", i + j), ("d", F.abs(i - j)))])
    q = F.col("q").cast("double")
    k = F.col("k").cast("double")
    margins = glcm.select(*keys, "n", F.inline(kinds)).groupBy(*keys, "kind", "k").agg(F.sum("n").alias("q"))
    of = lambda kind, v: F.sum(F.when(F.col("kind") == kind, v))
    sums = margins.groupBy(*keys).agg(*[
        of(kind, v).alias(f"{kind}{name}") for kind in ("m", "s", "d") for name, v in (("1", k * q), ("2", k * k * q), ("l", q * F.log2(q)))
    ])
    g = join_on(base, sums, keys)
    t = F.col("t")
    mean = lambda c: F.col(c) / t
    entropy = lambda c: F.log2(t) - F.col(c) / t
    var = mean("m2") - mean("m1") * mean("m1")
    hx, hxy = entropy("ml"), entropy("nl")
    g = g.select(
        *keys, (F.col("nn") / (t * t)).alias("angular_second_moment"), mean("d2").alias("contrast"),
        F.coalesce((mean("ij") - mean("m1") * mean("m1")) / F.when(var > 1e-12, var), F.lit(1.0)).alias("correlation"),
        var.alias("variance"), mean("idm").alias("inverse_difference_moment"), mean("s1").alias("sum_average"),
        (mean("s2") - mean("s1") * mean("s1")).alias("sum_variance"), entropy("sl").alias("sum_entropy"), hxy.alias("entropy"),
        (mean("d2") - mean("d1") * mean("d1")).alias("difference_variance"), entropy("dl").alias("difference_entropy"),
        F.coalesce((hxy - 2 * hx) / F.when(hx > 1e-12, hx), F.lit(0.0)).alias("info_measure_1"),
        F.sqrt(F.greatest(1 - F.exp(-2.0 * (2 * hx - hxy)), F.lit(0.0))).alias("info_measure_2"),
    )
    stats = [c for c in g.columns if c not in keys]
    mean = g.groupBy(*img, "label").agg(F.count(F.lit(1)).alias("__n"), *[F.avg(c).alias(c) for c in stats])
    j = join_on(objects.select(*img, "label", "area"), mean, [*img, "label"], "left")
    ok = (F.col("area") >= min_pixels) & (F.col("__n") == directions)
    return j.select(*img, "label", *[F.when(ok, F.col(c)).otherwise(0.0).alias(c) for c in stats])


def _running(a: np.ndarray, half: int, axis: int, fold: np.ufunc, empty: float) -> np.ndarray:
    """fold over the 2 * half + 1 cells around each cell along an axis; the span doubles, so the cost grows with its logarithm."""
    a = np.moveaxis(a, axis, 0)
    pad = np.full((half, *a.shape[1:]), empty)
    r, span, width = np.concatenate([pad, a, pad]), 1, 2 * half + 1
    while span * 2 <= width:
        r, span = fold(r[:-span], r[span:]), span * 2
    n = len(a)
    return np.moveaxis(fold(r[:n], r[width - span : width - span + n]), 0, axis)


def _opened(a: np.ndarray, there: np.ndarray, half: int) -> np.ndarray:
    """Grey opening of the present cells: row and column minima, then column and row maxima."""
    for axis in (1, 0):
        a = np.where(there, _running(np.where(there, a, np.inf), half, axis, np.minimum, np.inf), np.nan)
    for axis in (0, 1):
        a = np.where(there, _running(np.where(there, a, -np.inf), half, axis, np.maximum, -np.inf), np.nan)
    return a


def grey_openings(px: DataFrame, value: str, sizes: dict[str, int], img: Sequence[str] = IMG, block: int = 256) -> DataFrame:
    """Grey openings with squares of several sizes over the pixels present, one column (name -> size) each.

    The image is cut into blocks, and each pixel also goes to the blocks whose halo, twice the largest half side, it lies in. So
    one shuffle serves all sizes, and a task holds one block. A pixel must occur once.
    """
    halo = 2 * max((s - 1) // 2 for s in sizes.values())
    near = lambda c: F.sequence(F.floor((F.col(c) - halo) / block), F.floor((F.col(c) + halo) / block))
    kept = [c for c in px.columns if c not in sizes]
    sent = px.select(*kept, F.explode(near("y")).alias("__by")).withColumn("__bx", F.explode(near("x")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in px.schema if f.name in kept) + "".join(f", `{c}` double" for c in sizes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy() - (key[-2] * block - halo), pdf["x"].to_numpy() - (key[-1] * block - halo)
        own = (y >= halo) & (y < halo + block) & (x >= halo) & (x < halo + block)
        out = pdf.loc[own, kept].copy()
        if not len(out):  # a block beyond the border, reached by halos only
            return out.reindex(columns=[*kept, *sizes])
        a = np.full((block + 2 * halo,) * 2, np.nan)
        there = np.zeros(a.shape, bool)
        a[y, x], there[y, x] = pdf[value].to_numpy(float), True
        for name, size in sizes.items():
            out[name] = _opened(a, there, (size - 1) // 2)[y[own], x[own]]
        return out

    return sent.groupBy(*img, "__by", "__bx").applyInPandas(run, schema)


def _expanded(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, x) for every x from lo to hi - 1 of each row."""
    n = np.maximum(hi - lo, 0)
    return np.repeat(row, n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def object_pixels(
    runs: DataFrame, image: DataFrame, channels: Sequence[str], value: str, sizes: dict[str, int], img: Sequence[str] = IMG, block: int = 256,
    per_task: int = 32,
) -> DataFrame:
    """(image, label, y, x, channels, __in, __edge, openings): the image pixels in the bounding boxes of the objects.

    `__in` tells the pixels of the object itself from the rest of its box, `__edge` those with fewer than four neighbours of their
    label. The openings of `value` are those of the whole image (`grey_openings`), one column (name -> size) each. Image and runs are cut
    into the same blocks and meet there as arrays: the image, with its background, is moved once and not stored, and the
    tasks have about `per_task` blocks each. An image pixel must occur once.
    """
    from cytomill.operators.masks import boxes

    halo, at = max(1, 2 * max((s - 1) // 2 for s in sizes.values())), ["__by", "__bx"]
    near = lambda lo, hi: F.sequence(F.floor(lo / block), F.floor(hi / block))
    y, x = F.col("y"), F.col("x")
    left = image.select(*img, "y", "x", *channels).withColumn("__by", F.explode(near(y - halo, y + halo))).withColumn("__bx", F.explode(near(x - halo, x + halo)))
    rows = runs.select(*img, "label", "y", "x0", "x1", F.lit(True).alias("own"))
    box = spread(boxes(runs, img), img).select(*img, "label", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x0", "x1", F.lit(False).alias("own"))
    rows = rows.unionByName(box).na.drop(subset=[*img, "label"]).withColumn("__by", F.explode(near(y - 1, y + 1))).withColumn("__bx", F.explode(near(F.col("x0") - 1, F.col("x1"))))
    n = rows.select(*img, *at).distinct().count()
    n = max(image.sparkSession.sparkContext.defaultParallelism, -(-n // per_task))  # a given number is not merged again
    dealt = lambda d: d.repartition(n, *img, *at).groupBy(*img, *at)
    moved = [*img, "y", "x", *channels]
    types = {k: image.schema[k].dataType.simpleString() for k in moved} | {"label": runs.schema["label"].dataType.simpleString(), "__in": "boolean", "__edge": "boolean"}
    types |= dict.fromkeys(sizes, "double")

    def run(key: tuple, place: pa.Table, mask: pa.Table) -> pa.Table:
        y0, x0 = (int(k.as_py()) * block - halo for k in key[-2:])
        y, x = (place.column(c).to_numpy() - o for c, o in (("y", y0), ("x", x0)))
        index = np.full((block + 2 * halo,) * 2, -1)
        index[y, x] = np.arange(len(y))
        side = index.shape[1]
        lo, hi = (np.clip(mask.column(c).to_numpy() - x0, halo - 1, halo + block + 1) for c in ("x0", "x1"))
        row, px = _expanded(np.arange(len(lo)), lo, hi)
        py = mask.column("y").to_numpy()[row] - y0
        there = index[py, px] >= 0
        row, px, py = row[there], px[there], py[there]
        label = mask.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        spot = (label[row].astype(np.int64) * side + py) * side + px
        own = mask.column("own").to_numpy()[row]
        covered = np.unique(spot[own])
        has = lambda s: np.isin(s, covered)
        core = (py >= halo) & (py < halo + block) & (px >= halo) & (px < halo + block)
        keep = np.flatnonzero(core & (own | ~has(spot)))
        row, py, px, spot, own = row[keep], py[keep], px[keep], spot[keep], own[keep]
        edge = own & ~(has(spot - 1) & has(spot + 1) & has(spot - side) & has(spot + side))
        from_image = pa.array(index[py, px])
        out = {k: place.column(k).take(from_image) for k in moved} | {"label": mask.column("label").take(pa.array(row)), "__in": own, "__edge": edge}
        a = np.full(index.shape, np.nan)
        if len(row):
            a[y, x] = place.column(value).to_numpy().astype(float)
        for name, size in sizes.items():
            out[name] = _opened(a, index >= 0, (size - 1) // 2)[py, px] if len(row) else np.empty(0)
        return pa.table({k: out[k] for k in types})

    return dealt(left).cogroup(dealt(rows)).applyInArrow(run, ", ".join(f"`{k}` {v}" for k, v in types.items()))


def grey_opening(px: DataFrame, value: str, size: int, out: str, img: Sequence[str] = IMG) -> DataFrame:
    """Grey opening with a size x size square over the pixels present: min filter, then max filter."""
    return grey_openings(px, value, {out: size}, img)


def granularity(px: DataFrame, value: str, scales: int = 5, img: Sequence[str] = IMG) -> DataFrame:
    """Share of the starting mean lost at each opening scale, in percent, per labelled object (long)."""
    keys = [*img, "label"]
    return opened_spectrum(grey_openings(px.select(*keys, "y", "x", value), value, opening_sizes(scales), img), value, scales, img)


def opening_sizes(scales: int) -> dict[str, int]:
    return {f"__o{i}": 2 * i + 1 for i in range(1, scales + 1)}


def opened_spectrum(px: DataFrame, value: str, scales: int, img: Sequence[str] = IMG) -> DataFrame:
    """`granularity` of pixels that have the openings of `opening_sizes`."""
    keys = [*img, "label"]
    m = px.where(F.col("label") != 0).groupBy(*keys).agg(F.avg(value).alias("m0"), *[F.avg(f"__o{i}").alias(f"m{i}") for i in range(1, scales + 1)])
    rows = [
        F.struct(F.lit(i).cast("long").alias("scale"), ((F.col(f"m{i - 1}") - F.col(f"m{i}")) * 100 / F.greatest(F.col("m0"), F.lit(2.220446049250313e-16))).alias("granularity"))
        for i in range(1, scales + 1)
    ]
    return m.select(*keys, F.inline(F.array(*rows)))


def percentile_rescale(px: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float, degenerate: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Values clipped to two percentiles of their image and mapped to [0, scale]; a flat image gets `degenerate`."""
    q = quantiles(px, keys, value, {"__lo": lo / 100, "__hi": hi / 100})
    j = join_on(px, q, keys)
    unit = (F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    return j.withColumn("scaled", F.when(F.col("__hi") > F.col("__lo"), F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0)) * scale).otherwise(F.lit(degenerate))).drop("__lo", "__hi")


def tile_rescale(px: DataFrame, img: Sequence[str], value: str, tile: int, lo: float = 1.0, hi: float = 99.0) -> DataFrame:
    """The same per square tile, step-wise."""
    t = px.withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))
    return percentile_rescale(t, [*img, "ty", "tx"], value, lo, hi).drop("ty", "tx")


def marker_composite(px: DataFrame, markers: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Sum of the listed markers per output channel and pixel; `markers` maps marker to out_channel.

    The markers are a stain's panel, one row each, and are sent to every task: a shuffle by marker would leave as many tasks as there
    are markers. The rows of a pixel meet by image row, so that the shuffled rows stay in order and pack well.
    """
    listed = px.join(F.broadcast(markers), "marker").select(*img, "y", "x", "out_channel", "value").repartition(*img, "y")
    return listed.groupBy(*img, "y", "x", "out_channel").agg(F.sum("value").alias("value"))


def marker_profiles(px: DataFrame, markers: Sequence[str], img: Sequence[str] = IMG) -> DataFrame:
    """Mean per object and marker, arcsinh, z within the image (population std, 0 without spread). Long."""
    keys = [*img, "label"]
    m = px.groupBy(*keys).agg(*[F.asinh(F.avg(c)).alias(c) for c in markers])
    long = m.unpivot(keys, list(markers), "marker", "value")
    s = long.groupBy(*img, "marker").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    z = (F.col("value") - F.col("m")) / F.when(F.col("sd") > 0, F.col("sd"))
    return join_on(long, s, [*img, "marker"]).select(*keys, "marker", "value", F.coalesce(z, F.lit(0.0)).alias("z"))


def compare_expression(px_a: DataFrame, px_b: DataFrame, matches: DataFrame, markers: Sequence[str], img: Sequence[str] = IMG) -> tuple[DataFrame, DataFrame]:
    """(matched cells, markers): marker means of both objects of every match, and per image and marker the median absolute difference.

    `px_a`, `px_b` are marker values per mask pixel of the two segmentations, `matches` the pairs (image, a_label, b_label, iou).
    """
    def means(px: DataFrame, side: str) -> DataFrame:
        m = px.groupBy(*img, F.col("label").alias(f"{side}_label")).agg(*[F.avg(c).alias(c) for c in markers])
        return m.unpivot([*img, f"{side}_label"], list(markers), "marker", side)

    both = join_on(matches.select(*img, "a_label", "b_label", "iou"), means(px_a, "a"), [*img, "a_label"])
    both = cut(join_on(both, means(px_b, "b"), [*img, "b_label", "marker"]).withColumn("abs_diff", F.abs(F.col("a") - F.col("b"))))
    keys = [*img, "marker"]
    per = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matched"))
    return both, join_on(per, quantiles(both, keys, "abs_diff", {"median_abs_diff": 0.5}), keys, "left")


def merge_tile_features(features: DataFrame, keys: Sequence[str], area: str, columns: Sequence[str]) -> DataFrame:
    """Area-weighted merge of per-tile features of one object; associative, so Spark combines it map-side."""
    w = F.sum(area)
    return features.groupBy(*keys).agg(w.alias(area), *[(F.sum(F.col(c) * F.col(area)) / F.nullif(w, F.lit(0))).alias(c) for c in columns])
