"""Tiles, blocks, slices, lineages and candidate masks on the derived mask tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomill.functions import scalar as sc
from cytomill.operators import graph as gr
from cytomill.operators import masks as mk
from cytomill.operators import overlap as ov
from cytomill.operators import sampling as sm
from cytomill.operators import volume as vo
from cytomill.plans.regions import CAND, SIDE, STACK, candidates, stack
from cytomill.plans.registry import Tables, query, r, rnd
from cytomill.plans.shapes import CHANNELS, EDGE, TRUTH, intensity, runs
from cytomill.session import cut


def images(t: Tables) -> DataFrame:
    return runs(t).select("image_id").distinct().withColumn("height", F.lit(SIDE)).withColumn("width", F.lit(SIDE))


TILES = TRUTH + """, st_ as (select unnest(range(0, ceil(1.2 * 256 / 96)::int)) as i), tl as (select image_id, trunc(a.i * (160 / 3.0))::int as ty, trunc(b.i * (160 / 3.0))::int as tx from (select distinct image_id from rt), st_ a, st_ b)"""


@query("g01_make_tiles", f"with {TILES} select image_id, ty::bigint as ty, tx::bigint as tx from tl")
def _(t):
    return vo.make_tiles(images(t), 96).select("image_id", F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"))


@query("g02_average_tiles", f"""with {TILES}, {CHANNELS}, tp as (select pc.image_id, y, x, ty, tx, dna + tx as v, 1 / (1 + exp((abs(y - ty - 47.5) - 28) / 7.5)) * (1 / (1 + exp((abs(x - tx - 47.5) - 28) / 7.5))) as w from pc join tl on pc.image_id = tl.image_id
   and y >= ty and y < ty + 96 and x >= tx and x < tx + 96) select image_id, y, x, {r('sum(v * w) / sum(w)')} as v from tp group by 1, 2, 3""")
def _(t):
    tp = vo.tile_pixels(intensity(mk.run_pixels(runs(t))), vo.make_tiles(images(t), 96), 96, cells=True).withColumn("v", F.col("dna") + F.col("tx"))
    return vo.average_tiles(tp, "v", 96).withColumn("v", rnd("v"))


@query("g09_merge_tile_masks", f"""with {TRUTH}, tt as (select image_id % 2 as img, image_id // 2 as tile_no, y, x, label from pt), m as (select img, tile_no, max(label) as m from tt group by 1, 2),
   o as (select img, tile_no, coalesce(sum(m) over (partition by img order by tile_no rows between unbounded preceding and 1 preceding), 0)::bigint as off from m)
   select img as image_id, y, x, arg_max(label + off, tile_no) as label from tt join o using (img, tile_no) group by 1, 2, 3""")
def _(t):
    px = mk.run_pixels(runs(t)).withColumn("tile_no", F.floor(F.col("image_id") / 2)).withColumn("image_id", F.col("image_id") % 2)
    return vo.merge_tile_labels(px)


@query("g10_tile_ownership", f"""with {TRUTH}, tl as (select unnest([0, 80, 160]) as s), tp as (select pt.*, a.s as ty, b.s as tx from pt, tl a, tl b where y >= a.s and y < a.s + 96 and x >= b.s and x < b.s + 96)
   select image_id, y, x, label, ty::bigint as ty, tx::bigint as tx from tp where y >= case when ty > 0 then ty + 8 else 0 end and y < case when ty + 96 < 256 then ty + 88 else 256 end and x >= case when tx > 0 then tx + 8 else 0 end and x < case when tx + 96 < 256 then tx + 88 else 256 end""")
def _(t):
    starts = F.array(*[F.lit(s) for s in (0, 80, 160)])
    tiles = images(t).withColumn("ty", F.explode(starts)).withColumn("tx", F.explode(starts))
    tp = vo.tile_pixels(mk.run_pixels(runs(t)), tiles, 96)
    return vo.owned_pixels(tp, 96, 16, SIDE, SIDE).select("image_id", "y", "x", "label", F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"))


@query("g11_foreground_blocks", f"""with {TRUTH}, fb as (select distinct image_id, y // 24 as by_, x // 24 as bx from pt) select image_id, by_ as by, bx, greatest(by_ * 24 - 4, 0) as y0, greatest(bx * 24 - 4, 0) as x0, least((by_ + 1) * 24 + 4, 256) as y1, least((bx + 1) * 24 + 4, 256) as x1 from fb""")
def _(t):
    b = vo.foreground_blocks(vo.block_grid(images(t), 24, 4), runs(t), 24)
    return b.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("by", "bx", "y0", "x0", "y1", "x1")])


@query("g12_remove_overlaps", f"with {TRUTH} select image_id, y, x, label, y // 24 as by, x // 24 as bx from pt")
def _(t):
    b = vo.block_grid(images(t), 24, 4)
    px = mk.run_pixels(runs(t))
    px = px.withColumn("by", F.explode(F.array_distinct(F.array(F.floor((F.col("y") - 4) / 24), F.floor(F.col("y") / 24), F.floor((F.col("y") + 4) / 24)))))
    px = px.withColumn("bx", F.explode(F.array_distinct(F.array(F.floor((F.col("x") - 4) / 24), F.floor(F.col("x") / 24), F.floor((F.col("x") + 4) / 24)))))
    return vo.trim_halo(px.join(b.select("image_id", "by", "bx"), ["image_id", "by", "bx"]), 24)


def block_pixels(t: Tables) -> DataFrame:
    """Mask pixels with an id that is unique per block only (block number packed with the local label)."""
    px = mk.run_pixels(runs(t))
    block = F.col("image_id") * 121 + F.floor(F.col("y") / 24) * 11 + F.floor(F.col("x") / 24)
    return px.withColumn("gid", sc.pack_id(block, F.col("label")))


GID = TRUTH + """, bp as (select image_id, y, x, label, ((image_id * 121 + (y // 24) * 11 + x // 24) << 32) | label as gid from pt)"""


@query("f14_pack_ids", f"with {GID} select gid, count(*) as n from bp group by 1")
def _(t):
    return block_pixels(t).groupBy("gid").agg(F.count(F.lit(1)).alias("n"))


@query("j20_face_pairs", f"""with {GID} select distinct a.gid as src, b.gid as dst from bp a join bp b on a.image_id = b.image_id and ((b.y = a.y + 1 and b.x = a.x and b.y % 24 = 0) or (b.x = a.x + 1 and b.y = a.y and b.x % 24 = 0))""")
def _(t):
    return vo.face_pairs(block_pixels(t), 24)


@query("g13_merge_blocks", f"with {GID} select count(distinct gid) as n_parts, count(*) as n_px, image_id, label as object from bp group by image_id, label")
def _(t):
    m = vo.merge_blocks(block_pixels(t).withColumnRenamed("label", "object"), 24)
    per = m.groupBy("label").agg(F.countDistinct("gid").alias("n_parts"), F.count(F.lit(1)).alias("n_px"), F.min("image_id").alias("image_id"), F.min("object").alias("object"))
    return per.drop("label")


#: Objects of the truth mask as solids of 3 to 9 slices, in blocks of 8 x 24 x 24; the id is unique per block only.
SOLID_BLOCK, SOLID_SHAPE = {"z": 8, "y": 24, "x": 24}, {"z": 24, "y": SIDE, "x": SIDE}
SOLID = TRUTH + """, zp as (select pt.image_id, unnest(range(p_size % 5 + 1, p_size % 5 + 4 + p_size % 13)) as z, pt.y, pt.x, pt.label from pt join part on p_partkey // 256 = pt.image_id and p_partkey % 256 + 1 = pt.label),
 sp as (select *, ((image_id * 363 + (z // 8) * 121 + (y // 24) * 11 + x // 24) << 32) | label as gid from zp)"""


def solids(t: Tables) -> DataFrame:
    size = t.part.select(F.floor(F.col("p_partkey") / 256).cast("long").alias("image_id"), (F.col("p_partkey") % 256 + 1).cast("long").alias("label"), "p_size")
    px = mk.run_pixels(runs(t).join(size, ["image_id", "label"]))
    s = F.col("p_size")
    px = px.withColumn("z", F.explode(F.sequence((s % 5 + 1).cast("long"), (s % 5 + 3 + s % 13).cast("long")))).drop("p_size")
    block = F.col("image_id") * 363 + F.floor(F.col("z") / 8) * 121 + F.floor(F.col("y") / 24) * 11 + F.floor(F.col("x") / 24)
    return px.withColumn("gid", sc.pack_id(block, F.col("label")))


def _faces_sql() -> str:
    """SQL of the shrunk faces of each axis and side, and of the ids that meet."""
    out, met = [], []
    for a in "zyx":
        u, v = (c for c in "zyx" if c != a)
        for side, at, shift in (("l", f"({a} + 1) % {SOLID_BLOCK[a]} = 0 and {a} < {SOLID_SHAPE[a] - 1}", 0), ("h", f"{a} % {SOLID_BLOCK[a]} = 0 and {a} > 0", 1)):
            n = f"{side}{a}"
            out.append(f"f{n} as (select image_id, {a}, {u}, {v}, gid from sp where {at})")

            def beside(c: str, d: int) -> str:
                return f"(f.{c} + {d}) // {SOLID_BLOCK[c]} = f.{c} // {SOLID_BLOCK[c]} and f.{c} + {d} between 0 and {SOLID_SHAPE[c] - 1}"

            def joined(table: str, n_: int, c: str, d: int) -> str:
                o = v if c == u else u
                return f"left join {table} n{n_} on n{n_}.image_id = f.image_id and n{n_}.{a} = f.{a} and n{n_}.{c} = f.{c} + {d} and n{n_}.{o} = f.{o} and f.{c} + {d} >= 0 and (f.{c} + {d}) // {SOLID_BLOCK[c]} = f.{c} // {SOLID_BLOCK[c]}"

            near = [(0, u, -1), (1, u, 1), (2, v, -1), (3, v, 1)]
            label = lambda k, c, d: f"case when {beside(c, d)} then coalesce(n{k}.gid, 0) else f.gid end"  # noqa: E731, B023
            out.append(f"s{n} as (select f.* from f{n} f {' '.join(joined(f'f{n}', *x) for x in near)} where {label(*near[0])} = {label(*near[1])} and {label(*near[2])} = {label(*near[3])})")
            out.append(f"k{n} as (select f.* from s{n} f {' '.join(joined(f's{n}', *x) for x in near)} where " + " and ".join(f"(not ({beside(c, d)}) or n{k}.gid is not null)" for k, c, d in near) + ")")
        met.append(f"select distinct l.gid as src, h.gid as dst from kl{a} l join kh{a} h on h.image_id = l.image_id and h.{a} = l.{a} + 1 and h.{u} = l.{u} and h.{v} = l.{v}")
    return SOLID + ", " + ", ".join(out) + ", met as (" + " union ".join(met) + ")"


FACES = _faces_sql()


@query("j20_solid_faces", f"with {FACES} select src, dst from met")
def _(t):
    return vo.touching_faces(solids(t), SOLID_BLOCK, SOLID_SHAPE)


@query("g13_merge_volume", "with recursive " + FACES + """, both_ as (select src, dst from met union select dst, src from met), walk as (select distinct gid as a, gid as b from sp union select a, dst from walk join both_ on src = b),
   comp as (select a as gid, min(b) as root from walk group by 1), whole as (select root, count(distinct sp.gid) as n_parts, count(*) as n_px, min(image_id) as image_id, min(label) as object from sp join comp using (gid) group by 1)
   select n_parts, n_px, image_id, object from whole""")
def _(t):
    m = vo.merge_volume(solids(t).withColumnRenamed("label", "object"), SOLID_BLOCK, SOLID_SHAPE)
    per = m.groupBy("label").agg(F.countDistinct("gid").alias("n_parts"), F.count(F.lit(1)).alias("n_px"), F.min("image_id").alias("image_id"), F.min("object").alias("object"))
    return per.drop("label")


@query("g11_solid_blocks", f"""with {SOLID} select distinct image_id, z // 8 as b_z, y // 24 as b_y, x // 24 as b_x, greatest(z // 8 * 8 - 2, 0) as z0, least(z // 8 * 8 + 10, 24) as z1, greatest(y // 24 * 24 - 2, 0) as y0, least(y // 24 * 24 + 26, {SIDE}) as y1,
   greatest(x // 24 * 24 - 2, 0) as x0, least(x // 24 * 24 + 26, {SIDE}) as x1 from sp""")
def _(t):
    b = vo.volume_blocks(images(t).select("image_id"), SOLID_BLOCK, 2, SOLID_SHAPE)
    return vo.occupied_blocks(b, solids(t), SOLID_BLOCK)


@query("g12_trim_solids", f"with {SOLID} select image_id, z // 8 as b_z, y // 24 as b_y, x // 24 as b_x, count(*) as n_px, sum(label)::bigint as total from sp group by all")
def _(t):
    b = vo.volume_blocks(images(t).select("image_id"), SOLID_BLOCK, 2, SOLID_SHAPE)
    px = solids(t)
    for a, size in SOLID_BLOCK.items():
        px = px.withColumn(f"b_{a}", F.explode(F.array_distinct(F.array(*[F.floor((F.col(a) + d) / size) for d in (-2, 0, 2)]))))
    index = ["image_id", *[f"b_{a}" for a in SOLID_BLOCK]]
    trimmed = vo.trim_block_halo(px.join(b.select(*index), index), SOLID_BLOCK)
    return trimmed.groupBy(*index).agg(F.count(F.lit(1)).alias("n_px"), F.sum("label").alias("total"))


@query("g13_component_sizes", """with recursive e as (select distinct s_nationkey as n, s_suppkey as s from supplier) select count(*) as n_suppliers, min(s) as component from e group by n""")
def _(t):
    w = t.supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("hub"))
    e = t.supplier.join(w, "s_nationkey").select(F.col("s_suppkey").alias("src"), F.col("hub").alias("dst"))
    return gr.components(e, t.supplier.select(F.col("s_suppkey").alias("node"))).groupBy("component").agg(F.count(F.lit(1)).alias("n_suppliers"))


LINK = STACK + """, ar as (select volume, z, label, count(*) as area from st group by 1, 2, 3), io as (select o.*, n_px / (a.area + b.area - n_px) as iou, n_px / least(a.area, b.area) as iom from (select a.volume, a.z, a.label as a_label, b.label as b_label, count(*) as n_px
   from st a join st b on a.volume = b.volume and b.z = a.z + 1 and a.y = b.y and a.x = b.x group by 1, 2, 3, 4) o join ar a on a.volume = o.volume and a.z = o.z and a.label = a_label join ar b on b.volume = o.volume and b.z = o.z + 1 and b.label = b_label),
 l1 as (select * from io where iou >= 0.25 qualify row_number() over (partition by volume, z, a_label order by iou desc, b_label) = 1), lk as (select * from l1 qualify row_number() over (partition by volume, z, b_label order by iou desc, a_label) = 1)"""


@query("g14_stitch_links", f"with {LINK} select volume, z, a_label, b_label, {r('iou')} as iou from lk")
def _(t):
    return vo.stitch_links(stack(t)).select("volume", "z", "a_label", "b_label", rnd("iou").alias("iou"))


def _named(objects):
    return objects.withColumn("object_id", F.concat_ws("/", *[F.col(f"object_id.{c}").cast("string") for c in ("volume", "slice", "label")]))


@query("g14_stitch_slices", f"""with recursive {LINK}, ch as (select volume, z, label, volume::varchar || '/' || z || '/' || label as root from ar where not exists (select 1 from lk where lk.volume = ar.volume and lk.z + 1 = ar.z and lk.b_label = ar.label)
   union all select lk.volume, lk.z + 1, lk.b_label, ch.root from ch join lk on lk.volume = ch.volume and lk.z = ch.z and lk.a_label = ch.label) select root as object_id, count(*) as n_slices from ch group by 1""")
def _(t):
    s = _named(vo.stitch_slices(stack(t)))
    return s.groupBy("object_id").agg(F.countDistinct("z").alias("n_slices"))


@query("g15_merge_slices", f"""with recursive {LINK}, nd as (select volume, z, label, {{'v': volume, 's': z, 'l': label}} as id from ar), e0 as (select {{'v': volume, 's': z, 'l': a_label}} as a, {{'v': volume, 's': z + 1, 'l': b_label}} as b from io where iom >= 0.5),
   e as (select a, b from e0 union select b, a from e0), re as (select id as id, id as reach from nd union select re.id, e.b from re join e on e.a = re.reach), cc as (select id, min(reach) as root from re group by 1),
   ext as (select root, max(z) - min(z) + 1 as ext, count(*) as n_parts from cc join nd using (id) group by 1) select root.v || '/' || root.s || '/' || root.l as object_id, ext as extent, n_parts from ext where ext >= 2""")
def _(t):
    m = _named(vo.merge_slices(stack(t), 0.5, 2))
    return m.groupBy("object_id").agg((F.max("z") - F.min("z") + 1).alias("extent"), F.countDistinct("z", "label").alias("n_parts"))


@query("w11_offset_slices", f"""with {STACK}, m as (select volume, z, max(label) as m from st group by 1, 2), o as (select volume, z, coalesce(sum(m) over (partition by volume order by z rows between unbounded preceding and 1 preceding), 0)::bigint as off from m)
   select volume, z, y, x, label + off as label from st join o using (volume, z)""")
def _(t):
    return vo.offset_slices(mk.run_pixels(stack(t)), ["volume"])


@query("w12_close_gaps")
def _(t):
    return vo.close_gaps(mk.run_pixels(stack(t)), 1)


@query("w12_gap_pixels", f"""with {STACK}, g as (select *, lead(z) over (partition by volume, y, x order by z) - z - 1 as gap from st) select volume, count(*) as n_gap_px from g where gap = 1 group by 1""")
def _(t):
    from pyspark.sql import Window as W
    px = mk.run_pixels(stack(t))
    w = W.partitionBy("volume", "y", "x").orderBy("z")
    g = px.withColumn("gap", F.lead("z").over(w) - F.col("z") - 1).where("gap = 1")
    return g.groupBy("volume").agg(F.count(F.lit(1)).alias("n_gap_px"))


@query("w09_frame_centroids", f"""with {STACK}, c as (select volume, z, label, avg(y) as cy, avg(x) as cx from st group by 1, 2, 3) select volume, z, label, {r('cy')} as cy, {r('cx')} as cx,
   {r('coalesce(sqrt(pow(cy - lag(cy) over w, 2) + pow(cx - lag(cx) over w, 2)), 0)')} as step from c window w as (partition by volume, label order by z)""")
def _(t):
    f = vo.frame_table(stack(t), ["volume"])
    return f.select("volume", "z", "label", rnd("cy").alias("cy"), rnd("cx").alias("cx"), rnd("step").alias("step"))


def scored(t: Tables) -> DataFrame:
    return mk.areas(candidates(t)).withColumn("score", (F.col("label") * 7919 % 1000) / 1000)


@query("g16_nms")
def _(t):
    return vo.suppress(scored(t), ov.self_overlaps(candidates(t)), 0.3, 25)


@query("g17_paint_masks", f"with {CAND} select image_id, y, x, arg_max(cp.label, (area, -cp.label)) as label from cp join cb using (image_id, label) group by 1, 2, 3")
def _(t):
    return vo.paint_masks(candidates(t))


@query("g18_drop_covered")
def _(t):
    return vo.drop_covered(candidates(t)).select("image_id", "label").distinct()


@query("g18_nearest_median", f"""with {CAND}, m as (select image_id, label, quantile_cont(y::double, 0.5) as my, quantile_cont(x::double, 0.5) as mx from cp group by 1, 2)
   select image_id, y, x, arg_min(label, ((y - my) * (y - my) + (x - mx) * (x - mx), label)) as label from cp join m using (image_id, label) group by 1, 2, 3""")
def _(t):
    return vo.nearest_median(candidates(t))


@query("g19_connected_regions", f"with {TRUTH} select image_id, label, count(*) as n_px, 1::bigint as n_regions from pt group by 1, 2")
def _(t):
    c = gr.run_components(runs(t))
    return c.groupBy("image_id", "label").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("n_px"), F.countDistinct("component").alias("n_regions"))


@query("g21_fill_holes", f"with {TRUTH}, k as (select image_id, label, count(*) as area from pt group by 1, 2 having count(*) >= 15), n as (select image_id, label, dense_rank() over (partition by image_id order by label) as new, area from k) select image_id, new as label, area from n")
def _(t):
    ring = mk.run_pixels(runs(t))
    d = mk.neighbour_counts(ring).join(mk.deepest_pixels(ring).where("dist2 > 0").select("image_id", "label", "y", "x"), ["image_id", "label", "y", "x"], "left_anti")
    return mk.areas(vo.fill_holes(mk.pixel_runs(d.drop("same4")), 15))


@query("g22_outline_polygons", f"with {TRUTH}, {EDGE} select image_id, label, count(*) as n_vertices from nb where same4 < 4 group by 1, 2")
def _(t):
    p = vo.outline_polygons(mk.run_pixels(runs(t)))
    return p.select("image_id", "label", F.size("points").cast("long").alias("n_vertices"))


def diamonds(t: Tables) -> DataFrame:
    """Four vertices per part around its position."""
    p = t.part
    cx, cy, s = (F.col("p_partkey") * 37 % 250).cast("double"), (F.col("p_partkey") * 11 % 250).cast("double"), F.col("p_size").cast("double") / 4
    v = F.array(*[F.struct(F.lit(k).alias("k"), x.alias("x"), y.alias("y")) for k, (x, y) in enumerate(((cx + s, cy), (cx, cy + s), (cx - s, cy), (cx, cy - s)))])
    d = p.select(F.floor(F.col("p_partkey") / 256).cast("long").alias("image_id"), F.col("p_partkey").alias("cell_id"), F.inline(v))
    return d.withColumn("ord", F.col("cell_id") * 4 + F.col("k"))


@query("g08_rasterize", """with d as (select p_partkey // 256 as image_id, p_partkey as cell_id, (p_partkey * 37 % 250)::double as cx, (p_partkey * 11 % 250)::double as cy, p_size / 4.0 as s from part),
   v as (select image_id, cell_id, unnest([0, 1, 2, 3]) as k, unnest([cx + s, cx, cx - s, cx]) as x, unnest([cy, cy + s, cy, cy - s]) as y from d),
   e as (select a.image_id, a.cell_id, a.x, a.y, b.x as nx, b.y as ny from v a join v b on a.cell_id = b.cell_id and b.k = (a.k + 1) % 4),
   s as (select image_id, cell_id, unnest(range(greatest(ceil(least(y, ny)), 0)::bigint, (least(ceil(greatest(y, ny)) - 1, 255) + 1)::bigint)) as yy, x, y, nx, ny from e where y <> ny),
   c as (select image_id, cell_id, yy, x + (yy - y) * (nx - x) / (ny - y) as cx from s), p as (select *, row_number() over w as k, lead(cx) over w as ex from c window w as (partition by cell_id, yy order by cx)),
   l as (select image_id, cell_id, row_number() over (partition by image_id order by cell_id) as label from d),
   x as (select p.image_id, yy as y, unnest(range(greatest(ceil(cx), 0)::bigint, least(ceil(ex), 256)::bigint)) as x, label from p join l using (cell_id) where k % 2 = 1 and ex is not null)
   select image_id, y, x, max(label) as label from x group by 1, 2, 3""")
def _(t):
    return vo.rasterize(diamonds(t), SIDE, SIDE)


@query("p10_polygon_roi", """with d as (select p_partkey as cell_id, (p_partkey * 37 % 250)::double as cx, (p_partkey * 11 % 250)::double as cy, p_size / 4.0 as s from part),
   v as (select cell_id, unnest([0, 1, 2, 3]) as k, unnest([cx + s, cx, cx - s, cx]) as x, unnest([cy, cy + s, cy, cy - s]) as y from d), i as (select * from v where x >= 20 and x < 200 and y >= 20 and y < 200)
   select cell_id, k::bigint as k, x - 20 as x, y - 20 as y from i where cell_id in (select cell_id from i group by 1 having count(*) >= 3)""")
def _(t):
    inside = diamonds(t).where("x >= 20 and x < 200 and y >= 20 and y < 200")
    ok = inside.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("cell_id")
    return inside.join(ok, "cell_id", "left_semi").select("cell_id", F.col("k").cast("long").alias("k"), (F.col("x") - 20).alias("x"), (F.col("y") - 20).alias("y"))


# --- lineages: conversations as tracks; a turn's parent is the turn before it --------------------

TRK = "tr as (select conv_id * 1000 + turn as track_id, case when turn > 0 then conv_id * 1000 + turn - 1 end as parent, conv_id from conversations)"


def tracks(t: Tables) -> DataFrame:
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("track_id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"), "conv_id")


@query("g20_lineages", f"with {TRK}, ok as (select * from tr where parent in (select track_id from tr)), l as (select conv_id, min(track_id) as lineage, count(*) as n_tracks from tr group by 1) select tr.track_id, lineage, coalesce(ok.parent, -1) as parent, n_tracks from tr join l using (conv_id) left join ok using (track_id)")
def _(t):
    e = tracks(t).where("parent is not null").select("parent", F.col("track_id").alias("child"))
    return gr.lineages(tracks(t), e).fillna(-1, ["parent"])


@query("u05_singleton_tracks", """with e as (select conv_id * 1000 + turn - 1 as p, conv_id * 1000 + turn as c from conversations where turn > 0 and role = 'user')
   select conv_id * 1000 + turn as track_id from conversations where conv_id * 1000 + turn not in (select p from e union select c from e)""")
def _(t):
    e = t.conversations.where("turn > 0 and role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"), (F.col("conv_id") * 1000 + F.col("turn")).alias("child"))
    return gr.singletons(tracks(t), e)


# --- sampling -------------------------------------------------------------------------------------

U = lambda key, seed: f"(('0x' || substr(md5({key}::varchar || '|{seed}'), 1, 13))::bigint + 0.5) / 4503599627370496.0"


@query("k06_busiest_tiles", f"with {TRUTH}, n as (select image_id, y // 64 as ty, x // 64 as tx, count(distinct label) as n_objects from pt group by 1, 2, 3) select *, row_number() over (partition by image_id order by n_objects desc, ty, tx) as rank from n qualify rank <= 3")
def _(t):
    return sm.busiest_tiles(runs(t), 64, 3).withColumn("rank", F.col("rank").cast("long"))


@query("k07_weighted_sample", f"select doc_id, source, {r('-ln(' + U('doc_id', 7) + ') / n_chars', 9)} as priority from documents order by -ln({U('doc_id', 7)}) / n_chars, doc_id limit 100")
def _(t):
    s = sm.weighted_sample(t.documents.select("doc_id", "source", "n_chars"), "doc_id", F.col("n_chars"), 100, 7)
    return s.select("doc_id", "source", rnd("priority", 9).alias("priority"))


@query("k08_capped_sample", f"select doc_id, source from documents qualify row_number() over (partition by source order by {U('doc_id', 8)}, doc_id) <= 10")
def _(t):
    return sm.capped_per_group(t.documents.select("doc_id", "source"), ["source"], "doc_id", 10, 8)


@query("k09_seeded_subset", f"select o_orderkey from orders order by {U('o_orderkey', 9)}, o_orderkey limit 200")
def _(t):
    return sm.seeded_subset(t.orders.select("o_orderkey"), "o_orderkey", 200, 9)


@query("k10_stride", "select o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_orderstatus order by o_orderkey) as k from orders) where o_orderstatus <> 'P' and (k - 1) % 5 = 0 union all select o_orderkey, o_orderstatus from orders where o_orderstatus = 'P'")
def _(t):
    o = t.orders.select("o_orderkey", "o_orderstatus")
    return sm.stride(o.where("o_orderstatus <> 'P'"), ["o_orderstatus"], "o_orderkey", 5).unionByName(o.where("o_orderstatus = 'P'"))


@query("w10_first_per_group", "select s_suppkey, s_nationkey from supplier qualify row_number() over (partition by s_nationkey order by s_suppkey) <= 3")
def _(t):
    return sm.first_per_group(t.supplier.select("s_suppkey", "s_nationkey"), ["s_nationkey"], ["s_suppkey"], 3)


@query("k11_positive_prompts", f"with {TRUTH} select image_id, y, x, label from pt qualify row_number() over (partition by image_id, label order by " + U("(image_id || ',' || label || ',' || y || ',' || x)", 3) + ", y, x) <= 2")
def _(t):
    return sm.positive_prompts(mk.run_pixels(runs(t)), 2, 3)


@query("k11_negative_prompts", f"""with {TRUTH}, b as (select image_id, label, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from pt group by 1, 2), n as (select image_id, label, y, unnest(range(x0 - 2, x1 + 3)) as x from (select *, unnest(range(y0 - 2, y1 + 3)) as y from b)),
   g as (select distinct image_id, label, y + dy as y, x + dx as x from pt, (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) d(dy, dx)), f as (select * from n anti join g using (image_id, label, y, x))
   select image_id, label, y, x from f qualify row_number() over (partition by image_id, label order by """ + U("(image_id || ',' || label || ',' || y || ',' || x)", 3) + ", y, x) <= 2")
def _(t):
    return sm.negative_prompts(runs(t), 2, 2, 3)
