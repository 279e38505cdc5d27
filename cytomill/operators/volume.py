"""Tiles, blocks, slices: cutting, merging and stitching of label tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType

from cytomill.operators import masks as mk
from cytomill.operators.graph import components, merge_relabeling, run_components
from cytomill.operators.ordered import group_starts, join_on, ordinal, unfolded, whole_groups
from cytomill.operators.overlap import consecutive_overlap, run_overlap
from cytomill.session import cut

IMG = ("image_id",)
CELL = ("__gy", "__gx")


def tile_starts(length, tile: int, overlap: float):
    """Evenly spaced overlapping tile starts along one side, as an array column."""
    length = length if not isinstance(length, int) else F.lit(length)
    n = F.when(length <= tile, F.lit(1)).otherwise(F.ceil((1.0 + 2 * overlap) * length / tile).cast("int"))
    step = F.when(n > 1, (length - tile) / F.nullif(n - 1, F.lit(0)).cast("double")).otherwise(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i * step).cast("int"))


def make_tiles(images: DataFrame, tile: int, overlap: float = 0.1, height: str = "height", width: str = "width") -> DataFrame:
    """(image columns, tile, ty, tx) for every tile of every image; `tile` is the pair (ty, tx)."""
    t = images.withColumn("ty", F.explode(tile_starts(F.col(height), tile, overlap)))
    t = t.withColumn("tx", F.explode(tile_starts(F.col(width), tile, overlap)))
    return t.withColumn("tile", F.struct("ty", "tx"))


def tile_pixels(px: DataFrame, tiles: DataFrame, tile: int, img: Sequence[str] = IMG, cells: bool = False, per_task: int = 256) -> DataFrame:
    """Pixels copied into every tile that covers them; equi join on a coarse grid, then the exact test.

    The pixels are dealt by cell into so many partitions that each has about `per_task` tiles, so a task's share does not grow with the table.
    `cells` keeps the grid cell (CELL), by which the copies stay partitioned.
    """
    grid = F.explode(F.sequence(F.floor(F.col("ty") / tile), F.floor((F.col("ty") + tile - 1) / tile)))
    t = tiles.select(*img, "ty", "tx", grid.alias("__gy")).withColumn("__gx", F.explode(F.sequence(F.floor(F.col("tx") / tile), F.floor((F.col("tx") + tile - 1) / tile))))
    p = px.withColumn("__gy", F.floor(F.col("y") / tile)).withColumn("__gx", F.floor(F.col("x") / tile))
    inside = (F.col("y") >= F.col("ty")) & (F.col("y") < F.col("ty") + tile) & (F.col("x") >= F.col("tx")) & (F.col("x") < F.col("tx") + tile)
    keys = [*img, *CELL]
    n = max(px.sparkSession.sparkContext.defaultParallelism, -(-tiles.count() // per_task))  # a given number is not merged again
    out = p.repartition(n, *keys).join(unfolded(t), keys).where(inside)
    return out if cells else out.drop(*CELL)


def average_tiles(tiled: DataFrame, value: str, tile: int, img: Sequence[str] = IMG, sigma: float = 7.5) -> DataFrame:
    """Overlapping tile outputs blended with a sigmoid taper that falls off towards the tile edge."""
    # fixed values of the taper: a margin of 20 pixels, slope 7.5
    def taper(v, start):
        centre = F.abs(v - start - (tile - 1) / 2.0)
        return 1.0 / (1.0 + F.exp((centre - (tile / 2.0 - 20.0)) / sigma))

    w = taper(F.col("y"), F.col("ty")) * taper(F.col("x"), F.col("tx"))
    cell = [c for c in CELL if c in tiled.columns]  # a pixel has one cell, so the copies are not moved again
    return tiled.withColumn("__w", w).groupBy(*img, *cell, "y", "x").agg((F.sum(F.col(value) * F.col("__w")) / F.sum("__w")).alias(value)).drop(*cell)


def merge_tile_labels(tiles: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Label pixels of overlapping tiles (tile_no, y, x, label) in one frame: every tile's labels are
    moved past the largest label before it, and the later tile wins where it is not background."""
    top = tiles.groupBy(*img, "tile_no").agg(F.max("label").cast("long").alias("m"))
    w = W.partitionBy(*img).orderBy("tile_no").rowsBetween(W.unboundedPreceding, -1)  # one row per tile
    off = top.select(*img, "tile_no", F.coalesce(F.sum("m").over(w), F.lit(0)).alias("off"))
    j = join_on(tiles.where(F.col("label") != 0), off, [*img, "tile_no"])
    return j.groupBy(*img, "y", "x").agg(F.max_by(F.col("label") + F.col("off"), "tile_no").alias("label"))


def offset_slices(px: DataFrame, volume: Sequence[str], axis: str = "z") -> DataFrame:
    """Labels made unique across slices by the running sum of the slice maxima."""
    top = px.groupBy(*volume, axis).agg(F.max("label").cast("long").alias("m"))
    w = W.partitionBy(*volume).orderBy(axis).rowsBetween(W.unboundedPreceding, -1)  # one row per slice
    off = top.select(*volume, axis, F.coalesce(F.sum("m").over(w), F.lit(0)).alias("__off"))
    return join_on(px, off, [*volume, axis]).withColumn("label", F.col("label") + F.col("__off")).drop("__off")


def owned_pixels(tiled: DataFrame, tile: int, overlap: int, height: int, width: int) -> DataFrame:
    """Keeps a pixel only in the tile whose core covers it; cores end half an overlap before inner tile edges."""
    half = overlap // 2
    y0, x0 = F.when(F.col("ty") > 0, F.col("ty") + half).otherwise(F.lit(0)), F.when(F.col("tx") > 0, F.col("tx") + half).otherwise(F.lit(0))
    ey, ex = F.col("ty") + tile, F.col("tx") + tile
    y1, x1 = F.when(ey < height, ey - (overlap - half)).otherwise(F.lit(height)), F.when(ex < width, ex - (overlap - half)).otherwise(F.lit(width))
    return tiled.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))


def block_grid(images: DataFrame, block: int, overlap: int, height: str = "height", width: str = "width") -> DataFrame:
    """Blocks with a halo clamped to the image: block index, core origin and crop bounds."""
    b = images.withColumn("by", F.explode(F.sequence(F.lit(0), F.floor((F.col(height) - 1) / block).cast("int"))))
    b = b.withColumn("bx", F.explode(F.sequence(F.lit(0), F.floor((F.col(width) - 1) / block).cast("int"))))
    return (
        b.withColumn("y0", F.greatest(F.col("by") * block - overlap, F.lit(0))).withColumn("x0", F.greatest(F.col("bx") * block - overlap, F.lit(0)))
        .withColumn("y1", F.least((F.col("by") + 1) * block + overlap, F.col(height))).withColumn("x1", F.least((F.col("bx") + 1) * block + overlap, F.col(width)))
    )


def foreground_blocks(blocks: DataFrame, runs: DataFrame, block: int, img: Sequence[str] = IMG) -> DataFrame:
    """Blocks that hold at least one foreground pixel in their core."""
    fg = runs.select(*img, F.floor(F.col("y") / block).alias("by"), F.explode(F.sequence(F.floor(F.col("x0") / block), F.floor((F.col("x1") - 1) / block))).alias("bx")).distinct()
    return blocks.join(unfolded(fg), [*img, "by", "bx"], "left_semi")


def trim_halo(px: DataFrame, block: int) -> DataFrame:
    """Block pixels (global y, x) without the halo."""
    return px.where((F.floor(F.col("y") / block) == F.col("by")) & (F.floor(F.col("x") / block) == F.col("bx")))


def face_pairs(px: DataFrame, block: int, img: Sequence[str] = IMG, id: str = "gid", shrink: bool = False) -> DataFrame:
    """Ids that touch across a face between neighbouring blocks (src, dst).

    `shrink` first drops face pixels whose neighbours along the face carry another id.
    """
    out = None
    for axis, other in (("y", "x"), ("x", "y")):
        low = px.where((F.col(axis) + 1) % block == 0).select(*img, F.col(axis), F.col(other), F.col(id).alias("src"))
        high = px.where(F.col(axis) % block == 0).select(*img, (F.col(axis) - 1).alias(axis), F.col(other), F.col(id).alias("dst"))
        if shrink:
            low, high = _shrink_face(low, img, axis, other, "src"), _shrink_face(high, img, axis, other, "dst")
        e = unfolded(low).join(high, [*img, axis, other]).select("src", "dst").distinct()
        out = e if out is None else out.union(e)
    return out.distinct()


def _shrink_face(face: DataFrame, img: Sequence[str], axis: str, other: str, id: str) -> DataFrame:
    w = W.partitionBy(*img, axis).orderBy(other)
    same = lambda f, d: F.coalesce((f(id).over(w) == F.col(id)) & (F.abs(f(other).over(w) - F.col(other)) == 1), F.lit(False))
    return face.withColumn("__k", same(F.lag, -1) & same(F.lead, 1)).where("__k").drop("__k")


def _met_faces(t: pa.Table, keys: Sequence[str], block: list[list[int]], shape: list[list[int]], span: list[list[int]], shrink: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (src, dst) of `touching_faces` for whole groups of face pixels; sizes are given by the axis across the face, then along it."""
    starts = group_starts(t, keys)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
    axis, side, id = (t.column(c).to_numpy() for c in ("__axis", "__side", "__id"))
    at = [t.column(c).to_numpy() for c in ("__u", "__v")]
    size, end, wide = ([np.array([s[k] for s in sizes])[axis] for k in (0, 1)] for sizes in (block, shape, span))
    reach = [max(s[k] for s in span) for k in (0, 1)]
    spot = ((side * len(starts) + group) * reach[0] + at[0] % wide[0]) * reach[1] + at[1] % wide[1]
    order = np.lexsort((id, spot))
    if shrink:  # the largest id of a place
        order = order[np.append(np.diff(spot[order]) != 0, True)]
    spot, id = spot[order], id[order]

    def inside(k: int, d: int) -> np.ndarray:
        c, s, e = at[k][order], size[k][order], end[k][order]
        return ((c + d) // s == c // s) & (c + d >= 0) & (c + d < e)

    def value(of: np.ndarray, spots: np.ndarray, ids: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(spots, of), len(spots) - 1)
        return np.where(spots[k] == of, ids[k], 0) if len(spots) else np.zeros(len(of), id.dtype)

    if shrink:
        step = [reach[1], 1]
        near = {(k, d): inside(k, d) for k in (0, 1) for d in (-1, 1)}
        sent = [(at[k] >= 0)[order] & (at[k] < end[k])[order] for k in (0, 1)]  # a pixel within the image reaches no place beyond it
        seen = lambda k, d, spots, ids: np.where(sent[k], value(spot + d * step[k], spots, ids), 0)
        flat = np.ones(len(spot), bool)
        for k in (0, 1):
            before, behind = (np.where(near[k, d], seen(k, d, spot, id), id) for d in (-1, 1))
            flat &= before == behind
        left, held = (spot[flat], id[flat]), flat
        for (k, d), n in near.items():
            held = held & (~n | (seen(k, d, *left) != 0))
        spot, id = spot[held], id[held]
    half = len(starts) * reach[0] * reach[1]
    low, high = spot < half, spot >= half
    first = np.searchsorted(spot[high] - half, spot[low])
    n = np.searchsorted(spot[high] - half, spot[low], "right") - first
    dst = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    met = pd.DataFrame({"src": np.repeat(id[low], n), "dst": id[high][dst]}).drop_duplicates()
    return met["src"].to_numpy(), met["dst"].to_numpy()


def touching_faces(
    px: DataFrame, block: dict[str, int], shape: dict[str, int], img: Sequence[str] = IMG, id: str = "gid", shrink: bool = True
) -> DataFrame:
    """(src, dst): ids of label pixels that meet across a face between neighbouring blocks, in two or three dimensions.

    `block` and `shape` give the size of blocks and image along each axis column, e.g. {"z": 8, "y": 64, "x": 64}; ids are whole
    numbers over 0. With `shrink`, as published, labels are first shrunk within each face, as seen from its block, so that objects that only
    graze each other across a border stay apart: a pixel goes if the labels before and behind it differ along a face axis (at the face's
    edge: its own and the next one), and then if a neighbour in the face is background or has gone. Faces end at block and image borders,
    missing pixels are background. Only face pixels are shuffled, once for each face they lie in; both faces of a border meet in
    pieces of about 256 x 256 pixels.
    """
    axes = {a: [c for c in block if c != a] for a in block}
    faces = {a: (((F.col(a) + 1) % n == 0) & (F.col(a) < shape[a] - 1), (F.col(a) % n == 0) & (F.col(a) > 0)) for a, n in block.items()}
    any_face = reduce(lambda p, q: p | q, [f for both in faces.values() for f in both])
    px = cut(px.where(any_face).select(*img, *block, id))  # cheap to read again when a task is lost
    sizes = lambda of: [[of[c] for c in axes[a]] + [1] * (2 - len(axes[a])) for a in block]
    spans = {c: n * max(1, 256 // n) for c, n in block.items()}
    rows = []
    for k, (a, along) in enumerate(axes.items()):
        u, v = ([F.col(c).cast("long") for c in along] + [F.lit(0).cast("long")])[:2]
        piece = [F.floor(p / n) for p, n in zip((u, v), sizes(spans)[k], strict=True)]
        for side in (0, 1):
            names = dict(__axis=F.lit(k), __plane=F.col(a).cast("long") - side, __bu=piece[0], __bv=piece[1], __side=F.lit(side), __u=u, __v=v)
            rows.append(F.when(faces[a][side], F.struct(*[c.alias(n) for n, c in names.items()])))
    kind, keys = px.schema[id].dataType.simpleString(), [*img, "__axis", "__plane", "__bu", "__bv"]
    sent = px.na.drop(subset=[*img, id]).select(*img, F.col(id).alias("__id"), F.explode(F.array_compact(F.array(*rows))).alias("__o")).select(*img, "__id", "__o.*")
    sent = sent.repartition(*keys).sortWithinPartitions(*keys)
    given = sizes(block), sizes(shape), sizes(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _met_faces(t, keys, *given, shrink)], ["src", "dst"])

    return sent.mapInArrow(run, f"src {kind}, dst {kind}").distinct()


def merge_volume(
    px: DataFrame, block: dict[str, int], shape: dict[str, int], img: Sequence[str] = IMG, id: str = "gid", shrink: bool = True
) -> DataFrame:
    """Block-local ids joined into whole objects over the faces of all axes, renumbered 1..N (column label)."""
    new = merge_relabeling(touching_faces(px, block, shape, img, id, shrink), px.select(F.col(id).alias("node")).distinct())
    return unfolded(px).join(new.withColumnRenamed("node", id), id).withColumnRenamed("new_label", "label")


def volume_blocks(volumes: DataFrame, block: dict[str, int], overlap: int, shape: dict[str, int]) -> DataFrame:
    """Blocks of every volume row with a halo clamped to the volume: index b_<axis>, crop <axis>0 and <axis>1 per axis."""
    for axis, size in block.items():
        volumes = volumes.withColumn(f"b_{axis}", F.explode(F.sequence(F.lit(0), F.lit((shape[axis] - 1) // size)).cast("array<long>")))
    for axis, size in block.items():
        at = F.col(f"b_{axis}") * size
        volumes = volumes.withColumn(f"{axis}0", F.greatest(at - overlap, F.lit(0))).withColumn(f"{axis}1", F.least(at + size + overlap, F.lit(shape[axis])))
    return volumes


def occupied_blocks(blocks: DataFrame, px: DataFrame, block: dict[str, int], img: Sequence[str] = IMG) -> DataFrame:
    """Blocks whose core holds at least one foreground pixel."""
    index = [F.floor(F.col(a) / size).alias(f"b_{a}") for a, size in block.items()]
    return blocks.join(unfolded(px.select(*img, *index).distinct()), [*img, *[f"b_{a}" for a in block]], "left_semi")


def trim_block_halo(px: DataFrame, block: dict[str, int]) -> DataFrame:
    """Pixels (global places, block index b_<axis>) without the halo along any axis."""
    own = F.lit(True)
    for axis, size in block.items():
        own = own & (F.floor(F.col(axis) / size) == F.col(f"b_{axis}"))
    return px.where(own)


def merge_blocks(px: DataFrame, block: int, img: Sequence[str] = IMG, id: str = "gid") -> DataFrame:
    """Block-local ids joined into whole objects: components over touching faces, renumbered 1..N."""
    nodes = px.select(F.col(id).alias("node")).distinct()
    new = merge_relabeling(face_pairs(px, block, img, id), nodes)
    return unfolded(px).join(new.withColumnRenamed("node", id), id).withColumnRenamed("new_label", "label")


def slice_node(volume: str = "volume", axis: str = "z", label: str = "label"):
    """One id per (volume, slice, label)."""
    return F.struct(*[F.col(c).cast("long").alias(n) for n, c in (("volume", volume), ("slice", axis), ("label", label))])


def stitch_links(runs: DataFrame, threshold: float = 0.25, volume: str = "volume", axis: str = "z") -> DataFrame:
    """Links from an object (a, slice z) to the object of slice z+1 (b) that continues it.

    An old object keeps only its best new one, a new object its best remaining old one; both at
    IoU >= threshold, the smaller label on ties. The window groups are one object's partners.
    """
    p = consecutive_overlap(runs, [volume], axis).where(F.col("iou") >= threshold)
    old = W.partitionBy(volume, axis, "a_label").orderBy(F.desc("iou"), "b_label")
    new = W.partitionBy(volume, axis, "b_label").orderBy(F.desc("iou"), "a_label")
    return p.withColumn("__r", F.row_number().over(old)).where("__r = 1").withColumn("__r", F.row_number().over(new)).where("__r = 1").drop("__r")


def stitch_slices(runs: DataFrame, threshold: float = 0.25, volume: str = "volume", axis: str = "z") -> DataFrame:
    """Runs with one id per stitched object (the node id of its first slice)."""
    links = stitch_links(runs, threshold, volume, axis)
    e = links.select(slice_node(volume, axis, "a_label").alias("src"), _next(volume, axis).alias("dst"))
    nodes = runs.select(slice_node(volume, axis).alias("node")).distinct()
    comp = components(e, nodes)
    return runs.withColumn("node", slice_node(volume, axis)).join(comp, "node").withColumnRenamed("component", "object_id").drop("node")


def _next(volume: str, axis: str):
    return F.struct(F.col(volume).cast("long").alias("volume"), (F.col(axis) + 1).cast("long").alias("slice"), F.col("b_label").cast("long").alias("label"))


def merge_slices(runs: DataFrame, threshold: float = 0.5, min_extent: int = 1, volume: str = "volume", axis: str = "z") -> DataFrame:
    """Objects joined across slices when their overlap reaches a share of the smaller one; short ones dropped."""
    p = consecutive_overlap(runs, [volume], axis)
    p = p.where(F.col("n_px") / F.least("area_a", "area_b") >= threshold)
    e = p.select(slice_node(volume, axis, "a_label").alias("src"), _next(volume, axis).alias("dst"))
    comp = components(e, runs.select(slice_node(volume, axis).alias("node")).distinct())
    out = runs.withColumn("node", slice_node(volume, axis)).join(comp, "node").withColumnRenamed("component", "object_id").drop("node")
    return mk.filter_extent(out, [volume, "object_id"], axis, min_extent)


def close_gaps(px: DataFrame, gap_closing: int, volume: str = "volume", axis: str = "z", slices: int | None = None) -> DataFrame:
    """Label pixels with gaps along the axis closed by `gap_closing` rounds; labels count up from 1 through the slices.

    A column of pixels closes over gaps of up to 2 x `gap_closing` slices. In each slice the closed foreground falls into connected
    regions (diagonals count); a region becomes an object unless it covers more than one object of that slice, which then
    stay as they are. The first and last `gap_closing` slices (of `slices`, by default up to the last one seen) are not closed.
    Objects of a slice are numbered by regions in reading order, then by old label.
    """
    keys, spot = [volume, axis], [volume, axis, "y", "x"]
    px = unfolded(cut(px.select(*spot, "label")))
    if slices is None:
        sized = join_on(px, px.groupBy(volume).agg((F.max(axis) + 1).alias("__n")), [volume])
    else:
        sized = px.withColumn("__n", F.lit(slices))
    inner = lambda c: (c >= gap_closing) & (c < F.col("__n") - gap_closing)
    col = W.partitionBy(volume, "y", "x").orderBy(axis)  # one column of pixels
    n = sized.withColumn("__next", F.lead(axis).over(col)).withColumn("__gap", F.col("__next") - F.col(axis) - 1)
    gap = n.where((F.col("__gap") > 0) & (F.col("__gap") <= 2 * gap_closing)).withColumn(axis, F.explode(F.sequence(F.col(axis) + 1, F.col("__next") - 1)))
    closed = sized.unionByName(gap.select(*sized.columns)).where(inner(F.col(axis))).select(*spot)
    regions = run_components(mk.pixel_runs(closed.withColumn("label", F.lit(1)), keys), keys, diagonal=True)
    flat = unfolded(cut(mk.run_pixels(regions.select(*keys, "y", "x0", "x1", "component"))))
    both = unfolded(join_on(flat, px, spot, "left"))
    matched = both.groupBy(*keys, "component").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    several = matched.where("lo < hi").select(*keys, "component")
    stays = join_on(both, several, [*keys, "component"], "left_semi").where("label is not null").select(*keys, "label").distinct()
    stays = stays.unionByName(sized.where(~inner(F.col(axis))).select(*keys, "label").distinct())
    old = unfolded(cut(join_on(px, stays, [*keys, "label"], "left_semi").select(*spot, F.lit(1).alias("kind"), F.col("label").cast("long").alias("first"), F.lit(0).cast("long").alias("second"))))
    new = join_on(flat, several, [*keys, "component"], "left_anti")
    new = join_on(unfolded(new), old.select(*spot), spot, "left_anti").select(*spot, F.lit(0).alias("kind"), F.col("component.y").cast("long").alias("first"), F.col("component.x0").cast("long").alias("second"))
    objects = unfolded(old.unionByName(new))
    within = W.partitionBy(*keys).orderBy("kind", "first", "second")  # one slice's objects
    ranked = objects.select(*keys, "kind", "first", "second").distinct().withColumn("label", F.row_number().over(within).cast("long"))
    named = unfolded(join_on(objects, ranked, [*keys, "kind", "first", "second"]).select(*spot, "label"))
    return offset_slices(named, [volume], axis)


def suppress(candidates: DataFrame, pairs: DataFrame, threshold: float, min_size: int, img: Sequence[str] = IMG, id: str = "label", score: str = "score", overlap: str = "iou") -> DataFrame:
    """Greedy non-maximum suppression: highest score first, a candidate falls when it overlaps a kept one by
    more than `threshold`. Runs per connected group of overlapping candidates."""
    big = cut(candidates.where(F.col("area") > min_size))
    key = lambda c: F.struct(*img, F.col(c).alias("label"))
    p = join_on(join_on(pairs.where(F.col(overlap) > threshold), big.select(*img, F.col(id).alias("i")), [*img, "i"], "left_semi"),
                big.select(*img, F.col(id).alias("j")), [*img, "j"], "left_semi")
    p = cut(p.select(key("i").alias("a"), key("j").alias("b")))
    rows = unfolded(big).select(key(id).alias("a"), F.col(score).alias("s"))
    linked = p.union(p.select("b", "a")).groupBy("a").agg(F.collect_list(F.col("b.label")).alias("near"))
    comp = components(p, None, "a", "b").withColumnRenamed("node", "a")
    work = rows.join(linked, "a").join(comp, "a").select("component", "s", "near", F.col("a.label").alias("lab"), *[F.col(f"a.{c}") for c in img])
    schema = work.select(*img, F.col("lab").alias(id)).schema

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gone, kept = set(), []
        pdf = pdf.sort_values(["s", "lab"], ascending=[False, True])  # a component lies in one image
        for lab, near in pdf[["lab", "near"]].itertuples(index=False):
            kept.append(lab not in gone)
            if kept[-1]:
                gone.update(near)
        return pdf[kept].rename(columns={"lab": id})[schema.names]

    kept = work.groupBy("component").applyInPandas(solve, schema)
    alone = rows.join(p.select("a").union(p.select("b")), "a", "left_anti").select(*[F.col(f"a.{c}") for c in img], F.col("a.label").alias(id))
    return join_on(big, kept.union(alone), [*img, id], "left_semi")


def paint_masks(runs: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Candidates to one label image: the largest candidate owns a shared pixel (smaller label on ties)."""
    a = mk.areas(runs, img)
    px = mk.run_pixels(join_on(unfolded(runs), a, [*img, "label"]))
    return px.groupBy(*img, "y", "x").agg(F.max_by("label", F.struct(F.col("area"), -F.col("label"))).alias("label"))


def _covered(label: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, share: float) -> np.ndarray:
    """Labels to drop among the runs of masks that touch each other, by ascending size, then label."""
    ids, which = np.unique(label, return_inverse=True)
    n = np.maximum(x1 - x0, 0)
    run = np.repeat(np.arange(len(n)), n)
    x = x0[run] - x0.min() + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    width = int(x1.max() - x0.min())
    place = np.unique(which[run] * (width * int(y.max() - y.min() + 1)) + (y[run] - y.min()) * width + x)
    mask, place = np.divmod(place, width * int(y.max() - y.min() + 1))
    _, at = np.unique(place, return_inverse=True)
    cover = np.bincount(at)
    ends = np.searchsorted(mask, np.arange(len(ids) + 1))
    dropped = []
    for i in np.argsort(np.diff(ends), kind="stable").tolist():
        spots = at[ends[i] : ends[i + 1]]
        if len(spots) and (cover[spots] > 1).mean() >= share:
            cover[spots] -= 1
            dropped.append(i)
    return ids[dropped]


def drop_covered(runs: DataFrame, share: float = 0.75, img: Sequence[str] = IMG) -> DataFrame:
    """Masks without those covered by others for at least `share`, checked by ascending size with counts
    updated after every drop; the runs of masks that touch each other meet as arrays in one row."""
    runs = unfolded(cut(runs))
    o = run_overlap(runs, runs, img).where(F.col("a_label") < F.col("b_label"))
    key = lambda c: F.struct(*img, F.col(c).alias("label"))
    comp = unfolded(components(o.select(key("a_label").alias("src"), key("b_label").alias("dst"))).select("node.*", "component"))
    met = join_on(runs, comp, [*img, "label"]).groupBy(*img, "component").agg(F.collect_list(F.struct("label", "y", "x0", "x1")).alias("r"))

    @F.pandas_udf(ArrayType(runs.schema["label"].dataType))
    def solve(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for label, *places in parts:
            yield pd.Series([_covered(k, *(p.astype(np.int64) for p in c), share) for k, *c in zip(label, *places, strict=True)], dtype=object)

    bad = met.select(*img, F.explode(solve("r.label", "r.y", "r.x0", "r.x1")).alias("label"))
    return join_on(runs, bad, [*img, "label"], "left_anti")


def nearest_median(runs: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Contested pixels go to the mask whose median pixel is nearest (smaller label on ties)."""
    from cytomill.operators.ordered import median_mad_columns

    keys = [*img, "label"]
    px = mk.run_pixels(runs)
    m = median_mad_columns(px, keys, ["y", "x"]).groupBy(*keys).agg(
        F.max(F.when(F.col("feature") == "y", F.col("median"))).alias("my"), F.max(F.when(F.col("feature") == "x", F.col("median"))).alias("mx")
    )
    j = join_on(px, m, keys)
    d = (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")) + (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx"))
    return j.groupBy(*img, "y", "x").agg(F.min_by("label", F.struct(d, F.col("label"))).alias("label"))


def fill_holes(runs: DataFrame, min_size: int = 15, img: Sequence[str] = IMG) -> DataFrame:
    """Fills background enclosed by an object, drops small objects, renumbers 1..K.

    The gaps of an object inside its box (one pixel wider) are runs too; those not connected to the
    box border are holes. A filled pixel never overwrites another object.
    """
    keys = [*img, "label"]
    runs = cut(runs)
    b = mk.boxes(runs, img)
    w = W.partitionBy(*keys, "y").orderBy("x0")
    inner = join_on(runs, b.select(*keys, F.col("x0").alias("bx0"), F.col("x1").alias("bx1")), keys)
    first = F.row_number().over(w) == 1
    gaps = inner.withColumn("pieces", F.array(
        F.struct(F.when(first, F.col("bx0") - 1).alias("g0"), F.when(first, F.col("x0")).alias("g1")),
        F.struct(F.col("x1").alias("g0"), F.coalesce(F.lead("x0").over(w), F.col("bx1") + 1).alias("g1")),
    )).select(*keys, "y", F.inline("pieces")).where("g0 is not null and g0 < g1")
    runs, b = unfolded(runs), unfolded(b)
    rows = b.select(*keys, F.explode(F.array(F.col("y0") - 1, F.col("y1"))).alias("y"), (F.col("x0") - 1).alias("g0"), (F.col("x1") + 1).alias("g1"))
    full = b.select(*keys, F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), (F.col("x0") - 1).alias("g0"), (F.col("x1") + 1).alias("g1"))
    empty = join_on(full, runs.select(*keys, "y").distinct(), [*keys, "y"], "left_anti")
    bg = gaps.unionByName(rows).unionByName(empty).select(*keys, "y", F.col("g0").alias("x0"), F.col("g1").alias("x1"))
    bg = cut(bg)
    comp = run_components(bg.withColumnRenamed("label", "owner").withColumn("label", F.lit(0)), [*img, "owner"]).withColumnRenamed("label", "__l")
    edge = join_on(comp, b.select(*img, F.col("label").alias("owner"), F.col("y0").alias("oy0"), F.col("y1").alias("oy1"), F.col("x0").alias("ox0"), F.col("x1").alias("ox1")), [*img, "owner"])
    outside = edge.where((F.col("y") < F.col("oy0")) | (F.col("y") >= F.col("oy1")) | (F.col("x0") < F.col("ox0")) | (F.col("x1") > F.col("ox1"))).select("component").distinct()
    holes = comp.join(outside, "component", "left_anti").select(*img, "y", "x0", "x1", F.col("owner").alias("label"))
    taken = mk.run_pixels(runs).select(*img, "y", "x")
    patch = join_on(mk.run_pixels(holes), taken, [*img, "y", "x"], "left_anti").groupBy(*img, "y", "x").agg(F.min("label").alias("label"))
    merged = mk.pixel_runs(mk.run_pixels(runs).select(*img, "y", "x", "label").unionByName(patch), img)
    return mk.filter_by_area(merged, img, min_size)


def outline_polygons(px: DataFrame, img: Sequence[str] = IMG) -> DataFrame:
    """Boundary vertices of each object ordered by angle around its centroid (star-shaped outline)."""
    keys = [*img, "label"]
    c = px.groupBy(*keys).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    e = join_on(mk.outline_pixels(px, img), c, keys)
    ang = F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))
    pts = F.sort_array(F.collect_list(F.struct(F.round(ang, 9).alias("a"), F.col("x"), F.col("y"))))
    return e.groupBy(*keys).agg(pts.alias("p")).select(*keys, F.transform("p", lambda s: F.struct(s.x.cast("double").alias("x"), s.y.cast("double").alias("y"))).alias("points"))


def rasterize(vertices: DataFrame, height: int, width: int, img: Sequence[str] = IMG, cell: str = "cell_id", order: str = "ord") -> DataFrame:
    """Polygons (vertex rows in `order`) to label pixels by scanline; label = order of first appearance,
    later polygons overwrite earlier ones."""
    first = vertices.groupBy(*img, cell).agg(F.min(order).alias("__o"))
    lab = ordinal(first, img, "__o", "label", [cell]).drop("label_of")
    w = W.partitionBy(*img, cell).orderBy(order)  # one polygon's vertices
    e = vertices.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w))
    e = e.withColumn("fx", F.first("x").over(w)).withColumn("fy", F.first("y").over(w))
    e = e.withColumn("nx", F.coalesce("nx", "fx")).withColumn("ny", F.coalesce("ny", "fy"))
    lo, hi = F.least("y", "ny"), F.greatest("y", "ny")
    a, b = F.greatest(F.ceil(lo), F.lit(0)).cast("long"), F.least(F.ceil(hi) - 1, F.lit(height - 1)).cast("long")
    s = e.where((F.col("y") != F.col("ny"))).withColumn("a", a).withColumn("b", b).where("a <= b").withColumn("row", F.explode(F.sequence("a", "b")))
    cx = F.col("x") + (F.col("row") - F.col("y")) * (F.col("nx") - F.col("x")) / (F.col("ny") - F.col("y"))
    s = s.select(*img, cell, "row", cx.alias("cx"))
    k = W.partitionBy(*img, cell, "row").orderBy("cx")
    s = s.withColumn("k", F.row_number().over(k)).withColumn("ex", F.lead("cx").over(k)).where("k % 2 = 1 and ex is not null")
    x0, x1 = F.greatest(F.ceil("cx"), F.lit(0)).cast("long"), F.least(F.ceil("ex"), F.lit(width)).cast("long")
    runs = s.select(*img, cell, F.col("row").alias("y"), x0.alias("x0"), x1.alias("x1")).where("x0 < x1")
    px = mk.run_pixels(join_on(runs, lab.select(*img, cell, "label"), [*img, cell]))
    return px.groupBy(*img, "y", "x").agg(F.max("label").alias("label"))


def frame_table(runs: DataFrame, img: Sequence[str], frame: str = "z") -> DataFrame:
    """Centroid per object and frame with the step from the frame before (one object's frames per window)."""
    c = mk.centroids(runs, [*img, frame])
    w = W.partitionBy(*img, "label").orderBy(frame)
    dy, dx = F.col("cy") - F.lag("cy").over(w), F.col("cx") - F.lag("cx").over(w)
    return c.withColumn("step", F.coalesce(F.sqrt(dy * dy + dx * dx), F.lit(0.0)))
