"""Masks, points in regions, overlaps, matching and segmentation scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomill.functions import scalar as sc
from cytomill.operators import cells as cl
from cytomill.operators import masks as mk
from cytomill.operators import matching as mt
from cytomill.operators import overlap as ov
from cytomill.operators.ordered import join_on, unfolded
from cytomill.plans.registry import Tables, query, r, rnd
from cytomill.plans.shapes import EDGE, PRED, SIDE, TRUTH, runs

# --- J-01 .. J-04: transcripts (line items) on the truth mask ---------------------------------

PTS_SQL = TRUTH + """, pts as (select l_orderkey, l_linenumber, l_partkey // 256 as image_id, l_suppkey, trunc((l_extendedprice - 500) / 300)::bigint as x,
    trunc(l_quantity * 6.1 - 10)::bigint as y from lineitem)"""


def points(t: Tables) -> DataFrame:
    """One point per line item, some outside the 256 x 256 image."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.floor(F.col("l_partkey") / 256).cast("long").alias("image_id"), "l_suppkey",
        sc.to_pixels(F.col("l_extendedprice") - 500, 300.0).cast("long").alias("x"), (F.col("l_quantity") * 6.1 - 10).cast("int").cast("long").alias("y"),
    )


@query("p01_points_to_pixels", """select l_orderkey, l_linenumber, trunc(l_extendedprice / 0.2125)::bigint - 1000 as px, trunc(l_quantity / 0.2125)::bigint - 20 as py from lineitem
  where trunc(l_extendedprice / 0.2125) >= 1000 and trunc(l_extendedprice / 0.2125) < 300000 and trunc(l_quantity / 0.2125) >= 20 and trunc(l_quantity / 0.2125) < 200""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", sc.to_pixels(F.col("l_extendedprice"), 0.2125).alias("px"), sc.to_pixels(F.col("l_quantity"), 0.2125).alias("py"))
    roi = (F.col("px") >= 1000) & (F.col("px") < 300000) & (F.col("py") >= 20) & (F.col("py") < 200)
    return d.where(roi).select("l_orderkey", "l_linenumber", (F.col("px") - 1000).cast("long").alias("px"), (F.col("py") - 20).cast("long").alias("py"))


@query("p02_centroids_to_pixels", "select s_suppkey, trunc(s_acctbal / 0.2125)::bigint as px from supplier where trunc(s_acctbal / 0.2125) >= 0")
def _(t):
    return t.supplier.select("s_suppkey", sc.to_pixels(F.col("s_acctbal"), 0.2125).cast("long").alias("px")).where("px >= 0")


@query("p03_unit_conversion", f"select o_orderkey, trunc(o_totalprice / 0.2125)::bigint as px, {r('trunc(o_totalprice / 0.2125) * 0.2125')} as um from orders")
def _(t):
    px = sc.to_pixels(F.col("o_totalprice"), 0.2125)
    return t.orders.select("o_orderkey", px.cast("long").alias("px"), rnd(sc.to_microns(px.cast("double"), 0.2125)).alias("um"))


CLIP = PTS_SQL + """, cl as (select *, greatest(0, least(x, 255)) as cx, greatest(0, least(y, 255)) as cy from pts),
  asg as (select cl.*, coalesce(pt.label, 0) as label from cl left join pt on pt.image_id = cl.image_id and pt.x = cl.cx and pt.y = cl.cy)"""


def assigned(t: Tables) -> DataFrame:
    return ov.assign_points(ov.place_points(points(t), "clip", SIDE, SIDE), runs(t))


@query("j01_assign_points", f"with {CLIP} select l_orderkey, l_linenumber, image_id, l_suppkey, cx as x, cy as y, label from asg")
def _(t):
    return assigned(t)


@query("j02_unassigned_fraction", f"""with {TRUTH}, pts as (select l_partkey // 256 as image_id, round_even((l_extendedprice - 500) / 300, 0)::bigint as x, round_even(l_quantity * 6.1 - 10, 0)::bigint as y from lineitem),
   inb as (select pts.*, pt.label from pts left join pt using (image_id, x, y) where x >= 0 and x < 256 and y >= 0 and y < 256)
   select image_id, count(*) as n_points, {r('avg((label is null)::int)')} as unassigned_fraction from inb group by 1""")
def _(t):
    p = t.lineitem.select(
        F.floor(F.col("l_partkey") / 256).cast("long").alias("image_id"), sc.to_pixels_half_even(F.col("l_extendedprice") - 500, 300.0).cast("long").alias("x"),
        F.bround(F.col("l_quantity") * 6.1 - 10).cast("long").alias("y"),
    )
    return ov.unassigned_fraction(p, runs(t), SIDE, SIDE).withColumn("unassigned_fraction", rnd("unassigned_fraction"))


@query("j03_hit_labels", f"with {CLIP} select distinct image_id, label from asg where label <> 0")
def _(t):
    return ov.hit_labels(ov.place_points(points(t), "clip", SIDE, SIDE), runs(t))


@query("j04_centroid_to_mask", f"""with {PTS_SQL} select l_orderkey, l_linenumber, coalesce(pt.label, 0) as label from pts left join pt on pt.image_id = pts.image_id
   and pt.x = pts.x and pt.y = pts.y and pts.x >= 0 and pts.x < 256 and pts.y >= 0 and pts.y < 256""")
def _(t):
    return ov.assign_points(points(t), runs(t)).select("l_orderkey", "l_linenumber", "label")


# --- object geometry ----------------------------------------------------------------------------


@query("a01_areas", f"with {TRUTH} select image_id, label, count(*) as area from pt group by 1, 2")
def _(t):
    return mk.areas(runs(t))


@query("a02_centroids", f"with {TRUTH} select image_id, label, {r('avg(y)')} as cy, {r('avg(x)')} as cx, count(*) as area from pt group by 1, 2")
def _(t):
    return mk.centroids(runs(t)).select("image_id", "label", rnd("cy").alias("cy"), rnd("cx").alias("cx"), "area")


@query("a03_boxes", f"with {TRUTH} select image_id, label, min(y) + image_id * 256 as y0, min(x) as x0, max(y) + image_id * 256 + 1 as y1, max(x) + 1 as x1 from pt group by 1, 2")
def _(t):
    return mk.boxes(runs(t), origin_y=F.col("image_id") * SIDE)


@query("a03_inclusive_boxes", f"with {TRUTH} select image_id, label, min(y) as y0, min(x) as x0, max(y) as y1, max(x) as x1 from pt group by 1, 2")
def _(t):
    return mk.inclusive_boxes(runs(t))


@query("a04_merge_boxes", f"with {TRUTH} select label, min(y) as y0, min(x) as x0, max(y) + 1 as y1, max(x) + 1 as x1 from pt group by 1")
def _(t):
    return mk.merge_boxes(mk.boxes(runs(t)), ["label"])


MOMENTS = TRUTH + """, m as (select image_id, label, count(*) as n, avg(y) as cy, avg(x) as cx, var_pop(y) + 1 / 12.0 as uyy, var_pop(x) + 1 / 12.0 as uxx, covar_pop(x, y) as uxy,
   count(*) / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)) as extent from pt group by 1, 2),
 sh as (select *, (uxx + uyy + sqrt(pow(uxx - uyy, 2) + 4 * uxy * uxy)) / 2 as l1, greatest((uxx + uyy - sqrt(pow(uxx - uyy, 2) + 4 * uxy * uxy)) / 2, 0) as l2 from m)"""


@query("a06_moment_shapes", f"""with {MOMENTS} select image_id, label, n as area, {r('cy')} as cy, {r('cx')} as cx, {r('extent')} as extent, {r('4 * sqrt(l1)')} as major_axis,
   {r('4 * sqrt(l2)')} as minor_axis, {r('sqrt(1 - l2 / l1)', 4)} as eccentricity, {r('2 * sqrt(n / pi())')} as equivalent_diameter from sh""")
def _(t):
    s = mk.moment_shapes(runs(t))
    return s.select("image_id", "label", "area", *[rnd(c, 4 if c == "eccentricity" else 6).alias(c) for c in ("cy", "cx", "extent", "major_axis", "minor_axis", "eccentricity", "equivalent_diameter")])


#: SQL of the shape columns. The hull depends on an object's drawn width and height alone, so it is worked out once for each such
#: shape: a line through two edge midpoints bounds the hull if no midpoint lies to its right.
SHAPES = """kinds as (select distinct w, h from obj_t),
 rows_k as (select w, h, j as y, 0 as lo, w - j % 3 - 1 as hi from (select *, unnest(range(0, h)) as j from kinds)),
 mid_k as (select distinct w, h, unnest([2 * y, 2 * y, 2 * y - 1, 2 * y + 1, 2 * y - 1, 2 * y + 1]) as y, unnest([2 * lo - 1, 2 * hi + 1, 2 * lo, 2 * lo, 2 * hi, 2 * hi]) as x from rows_k),
 line_k as (select p.w, p.h, p.y as py, p.x as px, q.y as qy, q.x as qx from mid_k p join mid_k q on p.w = q.w and p.h = q.h and (p.y <> q.y or p.x <> q.x)),
 side_k as (select l.* from line_k l join mid_k r on r.w = l.w and r.h = l.h group by all having min((qx - px) * (r.y - py) - (qy - py) * (r.x - px)) >= 0),
 grid_k as (select w, h, y, unnest(range(0, w)) as x from (select *, unnest(range(0, h)) as y from kinds)),
 hull_k as (select w, h, count(*) as convex_area from (select g.w, g.h, g.y, g.x from grid_k g join side_k l on l.w = g.w and l.h = g.h group by all
   having min((qx - px) * (2 * g.y - py) - (qy - py) * (2 * g.x - px)) >= 0) group by 1, 2),
 feret_k as (select w, h, max(sqrt(pow(px - qx, 2) + pow(py - qy, 2))) / 2 as feret from line_k group by 1, 2),
 hull as (select image_id, label, convex_area, feret from obj_t join hull_k using (w, h) join feret_k using (w, h)),
 ob as (select image_id, label, y, x from nb where same4 < 4),
 on_ as (select ob.*, (select count(*) from ob b where b.image_id = ob.image_id and b.label = ob.label and abs(b.y - ob.y) + abs(b.x - ob.x) = 1) as s,
   (select count(*) from ob b where b.image_id = ob.image_id and b.label = ob.label and abs(b.y - ob.y) = 1 and abs(b.x - ob.x) = 1) as d from ob),
 pe as (select image_id, label, sum(case 1 + 2 * s + 10 * d when 5 then 1 when 7 then 1 when 15 then 1 when 17 then 1 when 25 then 1 when 27 then 1 when 21 then sqrt(2.0)
   when 33 then sqrt(2.0) when 13 then (1 + sqrt(2.0)) / 2 when 23 then (1 + sqrt(2.0)) / 2 else 0 end) as perimeter from on_ group by 1, 2),
 mo as (select image_id, label, count(*) as n, avg(y) as cy, avg(x) as cx, var_pop(y) as uyy, var_pop(x) as uxx, covar_pop(x, y) as uxy,
   (max(y) - min(y) + 1) * (max(x) - min(x) + 1) as box from pt group by 1, 2),
 ax as (select *, sqrt(pow(uxx - uyy, 2) + 4 * uxy * uxy) as rt from mo),
 shp as (select *, (uxx + uyy + rt) / 2 as l1, greatest((uxx + uyy - rt) / 2, 0) as l2 from ax join pe using (image_id, label) join hull using (image_id, label))"""
SHAPE_SQL = f"""with {TRUTH}, {EDGE}, {SHAPES} select image_id, label, n as area, {r('perimeter')} as perimeter, {r('case when l1 > 0 then sqrt(1 - l2 / l1) else 0 end', 4)} as eccentricity,
   {r('n / convex_area')} as solidity, {r('n / box')} as extent, {r('4 * sqrt(l1)', 5)} as major_axis_length, {r('4 * sqrt(l2)', 5)} as minor_axis_length,
   {r('case when abs(uxx - uyy) < 1e-9 then case when uxy > 1e-9 then pi() / 4 else -pi() / 4 end else 0.5 * atan2(2 * uxy, uyy - uxx) end', 4)} as orientation,
   {r('sqrt(4 * n / pi())')} as equivalent_diameter, {r('4 * pi() * n / (perimeter * perimeter)')} as compactness, {r('4 * pi() * n / (perimeter * perimeter)')} as form_factor,
   FERET as max_feret_diameter, 1::bigint as euler_number, {r('cy')} as cy, {r('cx')} as cx from shp"""
COARSE = {"eccentricity": 4, "orientation": 4, "major_axis_length": 5, "minor_axis_length": 5}


def shape_columns(s: DataFrame) -> DataFrame:
    whole = ("image_id", "label", "area", "euler_number")
    return s.select(*[c if c in whole else rnd(c, COARSE.get(c, 6)).alias(c) for c in s.columns])


@query("a06_shape_features", SHAPE_SQL.replace("FERET", r("4 * sqrt(l1)")))
def _(t):
    return shape_columns(cl.shape_features(runs(t)))


@query("a06_exact_shapes", SHAPE_SQL.replace("FERET", r("feret")))
def _(t):
    return shape_columns(cl.shape_features(runs(t), exact=True))


@query("g03_outline_pixels", f"with {TRUTH}, {EDGE} select image_id, y, x, label from nb where same4 < 4")
def _(t):
    return mk.outline_pixels(mk.run_pixels(runs(t)))


PERIM = TRUTH + ", " + EDGE + """, e as (select image_id, y, x, label from nb where same4 < 4),
  ec as (select e.*, (select count(*) from e b where b.image_id = e.image_id and b.label = e.label and abs(b.y - e.y) + abs(b.x - e.x) = 1) as s,
     (select count(*) from e b where b.image_id = e.image_id and b.label = e.label and abs(b.y - e.y) = 1 and abs(b.x - e.x) = 1) as d from e),
  per as (select image_id, label, sum(least(s, 2) / 2 + greatest(0, least(d, 2 - s)) * sqrt(2.0) / 2) as perimeter from ec group by 1, 2)"""


@query("g04_perimeters", f"with {PERIM} select image_id, label, {r('perimeter')} as perimeter from per")
def _(t):
    return mk.perimeters(mk.run_pixels(runs(t))).withColumn("perimeter", rnd("perimeter"))


@query("a05_morphology", f"""with {PERIM}, {MOMENTS.split(', m as', 1)[1].join(['m as', ''])} select image_id, label, n as area, {r('perimeter')} as perimeter,
   {r('least(4 * pi() * n / (perimeter * perimeter), 1)')} as circularity, {r('4 * sqrt(l1)')} as major_axis from sh join per using (image_id, label)""")
def _(t):
    s = join_on(mk.moment_shapes(runs(t)), mk.perimeters(mk.run_pixels(runs(t))), ["image_id", "label"])
    return s.select("image_id", "label", "area", rnd("perimeter").alias("perimeter"), rnd(sc.circularity(F.col("area"), F.col("perimeter"))).alias("circularity"), rnd("major_axis").alias("major_axis"))


@query("g05_solidity")
def _(t):
    return mk.solidity(runs(t))


@query("p04_filter_masks", f"""with {TRUTH}, ok as (select image_id, label, dense_rank() over (partition by image_id order by label) as new from (select image_id, label from pt group by 1, 2
   having count(*) between 30 and 90)) select image_id, y, x0, x1, new as label from rt join ok using (image_id, label)""")
def _(t):
    return mk.filter_by_area(runs(t), min_size=30, max_size=90)


@query("p05_drop_small", f"""with {TRUTH}, ok as (select image_id, label, dense_rank() over (partition by image_id order by label) as new from (select image_id, label from pt group by 1, 2
   having count(*) >= 50)) select image_id, y, x0, x1, new as label from rt join ok using (image_id, label)""")
def _(t):
    return mk.filter_by_area(runs(t), min_size=50)


@query("w01_relabel", f"with {PRED} select image_id, y, x0, x1, dense_rank() over (partition by image_id order by label) as label from rp")
def _(t):
    return mk.relabel(runs(t, "pred"))


@query("p06_drop_edge_objects", f"with {TRUTH} select * from rt where (image_id, label) not in (select (image_id, label) from pt group by image_id, label having min(y) <= 1 or min(x) <= 1 or max(y) + 1 >= 252 or max(x) + 1 >= 252)")
def _(t):
    shifted = runs(t).withColumn("y", F.col("y") - 1).withColumn("x0", F.col("x0") - 1).withColumn("x1", F.col("x1") - 1)
    d = mk.drop_edge_objects(shifted, 251, 251)
    return d.withColumn("y", F.col("y") + 1).withColumn("x0", F.col("x0") + 1).withColumn("x1", F.col("x1") + 1)


@query("p07_filter_extent", f"with {TRUTH} select * from rt where (image_id, label) in (select (image_id, label) from pt group by image_id, label having max(y) - min(y) + 1 >= 6)")
def _(t):
    return mk.filter_extent(runs(t), ["image_id", "label"], "y", 6)


@query("p09_min_objects", f"""with {PRED}, a as (select image_id, label, 2 * sqrt(count(*) / pi()) as d from pp group by 1, 2) select image_id, count(*) as n_objects, {r('greatest(avg(d), 5)')} as diameter
   from a group by 1 having count(*) >= 200""")
def _(t):
    return mk.filter_images_by_objects(runs(t, "pred"), 200).withColumn("diameter", rnd("diameter"))


@query("w08_column_major_rle", f"""with {TRUTH}, p as (select image_id, label, x * 256 + y as p from pt), g as (select *, p - row_number() over (partition by image_id, label order by p) as g from p),
   isl as (select image_id, label, min(p) as s, max(p) + 1 as e from g group by image_id, label, g),
   c as (select *, s - coalesce(lag(e) over (partition by image_id, label order by s), 0) as z, e - s as o from isl)
   select image_id, label, string_agg(z || ',' || o, ',' order by s) || case when max(e) < 65536 then ',' || (65536 - max(e)) else '' end as counts from c group by 1, 2""")
def _(t):
    return mk.rle_column_major(mk.run_pixels(runs(t)), SIDE, SIDE).withColumn("counts", F.array_join("counts", ","))


@query("g24_dilate", f"""with {TRUTH}, n1 as (select image_id, y + dy as y, x + dx as x, label, dy = 0 and dx = 0 as own from pt, (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) d(dy, dx))
   select image_id, y, x, coalesce(max(case when own then label end), max(label)) as label from n1 group by 1, 2, 3""")
def _(t):
    return mk.dilate(mk.run_pixels(runs(t)), 1)


DIST = TRUTH + ", " + EDGE + """, dt as (select a.image_id, a.label, a.y, a.x, min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) as dist2
    from nb a join nb b on a.image_id = b.image_id and a.label = b.label and b.same4 < 4 group by 1, 2, 3, 4)"""


@query("g23_distance_to_boundary", f"with {DIST} select image_id, label, y, x, dist2 from dt")
def _(t):
    return mk.distance_to_outline(mk.run_pixels(runs(t)))


@query("g25_object_centers", f"with {DIST} select image_id, label, y, x, dist2 from dt qualify row_number() over (partition by image_id, label order by dist2 desc, y, x) = 1")
def _(t):
    return mk.deepest_pixels(mk.run_pixels(runs(t)))


@query("g26_one_hot", f"""with {TRUTH}, ids as (select image_id, label, dense_rank() over (partition by image_id order by label) - 1 as channel from (select distinct image_id, label from rt
   where label in (select p_size from part))) select image_id, y, x, channel from pt join ids using (image_id, label)""")
def _(t):
    ids = join_on(runs(t).select("image_id", "label").distinct(), t.part.select(F.col("p_size").cast("long").alias("label")), ["label"], "left_semi")
    return mk.one_hot(runs(t), ids)


# --- overlap and matching -----------------------------------------------------------------------

ROWS = "o as (select l_suppkey as image_id, l_partkey % 10 as a_label, l_linenumber::bigint as b_label, count(*) as n_px from lineitem group by 1, 2, 3)"


def row_overlap(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % 10).alias("a"), F.col("l_linenumber").alias("b"))
    return ov.overlap_from_pairs(rows, ["image_id"], "a", "b")


@query("j06_label_overlap", f"with {ROWS} select * from o")
def _(t):
    return row_overlap(t)


RUNOV = TRUTH + ", " + PRED + """, ro as (select a.image_id, a.label as a_label, b.label as b_label, count(*) as n_px from pt a join pp b using (image_id, y, x) group by 1, 2, 3),
 aa as (select image_id, label as a_label, count(*) as area_a from pt group by 1, 2), ab as (select image_id, label as b_label, count(*) as area_b from pp group by 1, 2),
 iou as (select ro.*, area_a, area_b, n_px / (area_a + area_b - n_px) as iou from ro join aa using (image_id, a_label) join ab using (image_id, b_label)),
 cnt as (select image_id, count(distinct label) as n_true, (select count(distinct label) from pp where pp.image_id = pt.image_id) as n_pred from pt group by 1),
 pr as (select image_id, threshold, count(iou) as tp from (select cnt.image_id, threshold, iou.iou, row_number() over (partition by cnt.image_id, threshold, a_label order by iou.iou desc, b_label) as r1
     from cnt cross join (select unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::double as threshold) t left join iou on iou.image_id = cnt.image_id and iou.iou >= threshold) where iou is null or r1 = 1 group by 1, 2),
 ap as (select image_id, threshold, n_true, n_pred, tp, n_pred - tp as fp, n_true - tp as fn, tp / (n_true + n_pred - tp) as ap from pr join cnt using (image_id))"""


@query("j06_run_overlap", f"with {RUNOV} select * from ro")
def _(t):
    return ov.run_overlap(runs(t), runs(t, "pred"))


def pairs(t: Tables) -> DataFrame:
    a, b = runs(t), runs(t, "pred")
    ra, rb = {"label": "a_label", "area": "area_a"}, {"label": "b_label", "area": "area_b"}
    return ov.iou_pairs(ov.run_overlap(a, b), area_a=mk.areas(a).withColumnsRenamed(ra), area_b=mk.areas(b).withColumnsRenamed(rb))


@query("j07_iou", f"with {ROWS}, aa as (select image_id, a_label, sum(n_px)::bigint as area_a from o group by 1, 2), ab as (select image_id, b_label, sum(n_px)::bigint as area_b from o group by 1, 2) select o.*, area_a, area_b, "
       + r("n_px / (area_a + area_b - n_px)") + " as iou from o join aa using (image_id, a_label) join ab using (image_id, b_label) where a_label <> 0 and b_label <> 0")
def _(t):
    return ov.iou_pairs(row_overlap(t)).withColumn("iou", rnd("iou"))


@query("j08_cell_matching", f"with {RUNOV} select image_id, a_label, b_label, {r('iou')} as iou from iou where iou >= 0.5 qualify row_number() over (partition by image_id, a_label order by iou desc, b_label) = 1 and row_number() over (partition by image_id, b_label order by iou desc, a_label) = 1")
def _(t):
    return mt.strict_matches(pairs(t), [0.5]).select("image_id", "a_label", "b_label", rnd("iou").alias("iou"))


@query("j08_greedy_matching_low", f"""with recursive {ROWS}, aa as (select image_id, a_label, sum(n_px)::bigint as area_a from o group by 1, 2), ab as (select image_id, b_label, sum(n_px)::bigint as area_b from o group by 1, 2),
   iou as (select image_id, a_label, b_label, n_px / (area_a + area_b - n_px) as iou from o join aa using (image_id, a_label) join ab using (image_id, b_label) where a_label <> 0 and b_label <> 0),
   c as (select image_id, a_label, list(b_label order by iou desc, b_label) as bs, row_number() over (partition by image_id order by a_label) as k from iou where iou >= 0.1 group by 1, 2),
   g as (select distinct image_id, 0::bigint as k, null::bigint as a_label, null::bigint as b_label, []::bigint[] as taken from c
      union all select image_id, n.k, n.a_label, n.b_label, list_append(n.taken, n.b_label) from (select g.image_id, c.k, c.a_label, g.taken, list_filter(c.bs, lambda b: not list_contains(g.taken, b))[1] as b_label
        from g join c on c.image_id = g.image_id and c.k = g.k + 1) n)
   select image_id, a_label, b_label, {r('iou')} as iou from g join iou using (image_id, a_label, b_label)""")
def _(t):
    return mt.greedy_matches(ov.iou_pairs(row_overlap(t)), 0.1).withColumn("iou", rnd("iou"))


@query("j09_mask_ious")
def _(t):
    return mt.assigned_pairs(pairs(t)).select("image_id", "a_label", "b_label", "iou")


@query("u03_unmatched_truth", f"with {RUNOV} select image_id, a_label as label from aa where (image_id, a_label) not in (select (image_id, a_label) from iou where iou >= 0.5)")
def _(t):
    return mt.unmatched(runs(t), mt.strict_matches(pairs(t), [0.5]), "a_label")


@query("u03_unmatched_prediction", f"with {RUNOV} select image_id, b_label as label from ab where (image_id, b_label) not in (select (image_id, b_label) from iou where iou >= 0.5)")
def _(t):
    return mt.unmatched(runs(t, "pred"), mt.strict_matches(pairs(t), [0.5]), "b_label")


EDGE_P = EDGE.replace("nb as", "np as").replace(" from pt", " from pp").replace("from pt b", "from pp b")

HAUSDORFF = EDGE + ", " + EDGE_P + """, mm as (select image_id, a_label, b_label, iou from iou where iou >= 0.5),
 oo as (select mm.image_id, a_label, b_label, e.y as ey, e.x as ex, f.y as fy, f.x as fx, (e.y - f.y) * (e.y - f.y) + (e.x - f.x) * (e.x - f.x) as d2
    from mm join nb e on e.image_id = mm.image_id and e.label = a_label and e.same4 < 4 join np f on f.image_id = mm.image_id and f.label = b_label and f.same4 < 4),
 hd as (select image_id, a_label, b_label, sqrt(max(d)) as hausdorff from (select image_id, a_label, b_label, min(d2) as d from oo group by 1, 2, 3, ey, ex
    union all select image_id, a_label, b_label, min(d2) as d from oo group by 1, 2, 3, fy, fx) group by 1, 2, 3)"""


@query("j17_match_distances", f"with {RUNOV}, {HAUSDORFF} select mm.image_id, a_label, b_label, {r('iou')} as iou, {r('hausdorff')} as hausdorff from mm join hd using (image_id, a_label, b_label)")
def _(t):
    d = mt.outline_distances(mt.strict_matches(pairs(t), [0.5]), runs(t), runs(t, "pred"))
    return d.select("image_id", "a_label", "b_label", rnd("iou").alias("iou"), rnd("hausdorff").alias("hausdorff"))


@query("j17_match_summary", f"""with {RUNOV}, {HAUSDORFF}, m as (select image_id, count(*) as matched, avg(iou) as mi, quantile_cont(iou, 0.5) as md, avg(hausdorff) as mh from mm join hd using (image_id, a_label, b_label) group by 1)
   select image_id, n_true as n_a, n_pred as n_b, coalesce(matched, 0) as matched, {r('coalesce(matched, 0) / n_pred')} as precision, {r('coalesce(matched, 0) / n_true')} as recall,
   {r('2 * coalesce(matched, 0) / (n_pred + n_true)')} as f1, {r('coalesce(mi, 0)')} as mean_iou, {r('coalesce(md, 0)')} as median_iou, {r('coalesce(mh, 0)')} as mean_boundary_distance from cnt left join m using (image_id)""")
def _(t):
    d = mt.outline_distances(mt.strict_matches(pairs(t), [0.5]), runs(t), runs(t, "pred"))
    m = mt.match_summary(d, mt.object_counts(runs(t), "n_a"), mt.object_counts(runs(t, "pred"), "n_b"))
    return m.select("image_id", "n_a", "n_b", "matched", *[rnd(c).alias(c) for c in ("precision", "recall", "f1", "mean_iou", "median_iou", "mean_boundary_distance")])


def scores(t: Tables, thresholds=mt.STEPS) -> DataFrame:
    return mt.precision_table(pairs(t), mt.object_counts(runs(t), "n_true"), mt.object_counts(runs(t, "pred"), "n_pred"), thresholds)


@query("a23_average_precision", f"with {RUNOV} select image_id, threshold, n_true, n_pred, tp, fp, fn, {r('ap')} as ap from ap")
def _(t):
    return scores(t).select("image_id", "threshold", "n_true", "n_pred", "tp", "fp", "fn", rnd("ap").alias("ap"))


@query("a26_dataset_scores", f"""with {RUNOV}, d as (select image_id % 3 as dataset, threshold, avg(ap) as ap from ap where threshold in (0.5, 0.75, 0.9) group by 1, 2)
   select dataset, {r('max(case when threshold = 0.5 then ap end)')} as ap50, {r('max(case when threshold = 0.75 then ap end)')} as ap75, {r('max(case when threshold = 0.9 then ap end)')} as ap90, {r('avg(ap)')} as map from d group by 1""")
def _(t):
    s = mt.dataset_scores(scores(t, [0.5, 0.75, 0.9]).withColumn("dataset", F.col("image_id") % 3), ["dataset"])
    return s.select("dataset", *[rnd(c).alias(c) for c in ("ap50", "ap75", "ap90", "map")])


@query("a27_segmentation_accuracy", f"""with {RUNOV} select image_id, {r('avg(ap)')} as msa, {r('max(case when threshold = 0.5 then ap end)')} as sa50, {r('max(case when threshold = 0.75 then ap end)')} as sa75,
   {r('max(case when threshold = 0.5 then tp / n_pred end)')} as precision, {r('max(case when threshold = 0.5 then tp / n_true end)')} as recall, {r('max(case when threshold = 0.5 then 2 * tp / (n_true + n_pred) end)')} as f1 from ap group by 1""")
def _(t):
    s = mt.segmentation_accuracy(scores(t))
    return s.select("image_id", *[rnd(c).alias(c) for c in ("msa", "sa50", "sa75", "precision", "recall", "f1")])


@query("a28_iterative_prompting", f"with {RUNOV} select image_id % 4 as iteration, {r('avg(ap)')} as msa, count(distinct image_id) as n_images from ap group by 1")
def _(t):
    s = scores(t).withColumn("iteration", F.col("image_id") % 4)
    return s.groupBy("iteration").agg(rnd(F.avg("ap")).alias("msa"), F.countDistinct("image_id").alias("n_images"))


@query("a29_grouped_precision", f"""with {RUNOV}, g as (select case image_id % 3 when 0 then 'lung' when 1 then 'breast' else 'colon' end as cancer, case image_id % 2 when 0 then 'A' else 'B' end as platform, ap from ap where threshold = 0.5)
   select coalesce(cancer, 'all') as cancer, coalesce(platform, 'all') as platform, count(*) as n, {r('avg(ap)')} as ap from g group by grouping sets ((cancer), (platform), ())""")
def _(t):
    img = F.col("image_id")
    g = scores(t, [0.5]).withColumn("cancer", F.when(img % 3 == 0, "lung").when(img % 3 == 1, "breast").otherwise("colon")).withColumn("platform", F.when(img % 2 == 0, "A").otherwise("B"))
    s = g.groupingSets([["cancer"], ["platform"], []], "cancer", "platform").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("ap")).alias("ap"))
    return s.fillna("all", ["cancer", "platform"])


@query("a22_foreground_scores", f"""with {ROWS}, s as (select image_id, sum(n_px) filter (a_label <> 0 and b_label <> 0) as b, sum(n_px) filter (a_label <> 0) as na, sum(n_px) filter (b_label <> 0) as nb from o group by 1)
   select image_id, {r('2 * b / (na + nb)')} as dice, {r('b / (na + nb - b)')} as iou from s""")
def _(t):
    return mt.foreground_scores(row_overlap(t)).select("image_id", rnd("dice").alias("dice"), rnd("iou").alias("iou"))


@query("a24_aggregated_jaccard")
def _(t):
    a, b = mk.run_pixels(runs(t)), mk.run_pixels(runs(t, "pred"))
    union = a.select("image_id", "y", "x").union(b.select("image_id", "y", "x")).distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("union_px"))
    return mt.aggregated_jaccard(pairs(t), union)




def _outline_counts(source: str) -> str:
    """Outline pixels in range of each image pixel, outlines mirrored at the border."""
    return f"""select image_id, scale, py as y, px as x, count(*) as c from (
     select e.image_id, scale, unnest(range(my - rr, my + rr + 1)) as py, my, mx, r, rr from (select *, unnest([x, -1 - x, {2 * SIDE - 1} - x]) as mx from (select *, unnest([y, -1 - y, {2 * SIDE - 1} - y]) as my from {source} where same4 < 4)) e join rad using (image_id)) q,
     lateral (select unnest(range(mx - rr, mx + rr + 1)) as px) where py between 0 and {SIDE - 1} and px between 0 and {SIDE - 1} and (py - my) * (py - my) + (px - mx) * (px - mx) <= r * r group by 1, 2, 3, 4"""


@query("a25_boundary_scores", f"""with {TRUTH}, {PRED}, {EDGE}, {EDGE_P}, dm as (select image_id, quantile_cont(s, 0.5) * 2 / sqrt(pi()) as d from (select image_id, label, sqrt(count(*)) as s from pt group by 1, 2) group by 1),
   rad as (select *, floor(r)::bigint as rr from (select image_id, scale, greatest(1.0, scale * d) as r from dm, (select unnest([0.1, 0.3]) as scale))),
   ct as ({_outline_counts('nb')}), cp as ({_outline_counts('np')}),
   s as (select image_id, scale, count(*) filter (t = 1 and p = 1) as tp, count(*) filter (t = 0 and p = 1) as fp, count(*) filter (t = 1 and p = 0) as fn from (select image_id, scale, coalesce(ct.c, 0) as t, coalesce(cp.c, 0) as p from ct full join cp using (image_id, scale, y, x)) group by 1, 2)
   select image_id, scale::double as scale, {r('tp / (tp + fp)')} as precision, {r('tp / (tp + fn)')} as recall, {r('2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn))')} as f from s""")
def _(t):
    s = mt.boundary_scores(mk.run_pixels(runs(t)), mk.run_pixels(runs(t, "pred")), [0.1, 0.3], SIDE, SIDE)
    return s.select("image_id", "scale", *[rnd(c).alias(c) for c in ("precision", "recall", "f")])


@query("a19_cell_counts", f"with {TRUTH}, {PRED}, m as (select 'truth' as method, image_id, label from pt union all select 'pred', image_id, label from pp) select method, count(distinct (image_id, label)) as n_cells, {r('count(distinct (image_id, label)) / (count(distinct image_id) * 65536 / 1e6)', 2)} as per_megapixel from m group by 1")
def _(t):
    m = runs(t).withColumn("method", F.lit("truth")).unionByName(runs(t, "pred").withColumn("method", F.lit("pred")))
    n = m.groupBy("method").agg(F.countDistinct("image_id", "label").alias("n_cells"), F.countDistinct("image_id").alias("ni"))
    return n.select("method", "n_cells", rnd(F.col("n_cells") / (F.col("ni") * SIDE * SIDE / 1e6), 2).alias("per_megapixel"))


@query("a20_area_distribution", f"with {TRUTH}, {PRED}, a as (select 'truth' as method, count(*) as a from pt group by image_id, label union all select 'pred', count(*) from pp group by image_id, label) select method, count(*) as n, {r('avg(a)')} as mean, {r('stddev_pop(a)')} as std, quantile_cont(a::double, 0.5) as median, min(a) as min, max(a) as max, sum(a)::bigint as total from a group by 1")
def _(t):
    from cytomill.operators.results import distribution
    a = mk.areas(runs(t)).withColumn("method", F.lit("truth")).unionByName(mk.areas(runs(t, "pred")).withColumn("method", F.lit("pred")))
    d = distribution(a, ["method"], "area")
    return d.withColumn("mean", rnd("mean")).withColumn("std", rnd("std"))


@query("a34_count_instances", f"with {TRUTH} select image_id, count(distinct label) as n_instances from pt group by 1")
def _(t):
    return mt.object_counts(runs(t), "n_instances")


# --- box pairs and self overlaps (candidate masks from both methods) ------------------------------

CAND = TRUTH + ", " + PRED + """, cr as (select image_id, y, x0, x1, label from rt union all select image_id, y, x0, x1, label + 1000 from rp), cp as (select image_id, y, unnest(range(x0, x1)) as x, label from cr),
 cb as (select image_id, label, min(y) as y0, max(y) + 1 as y1, min(x) as x0, max(x) + 1 as x1, count(*) as area from cp group by 1, 2)"""


def candidates(t: Tables) -> DataFrame:
    return unfolded(runs(t).unionByName(runs(t, "pred").withColumn("label", F.col("label") + 1000)))  # a union drops the marks of its parts


@query("j22_box_overlaps", f"""with {CAND} select a.image_id, a.label as i, b.label as j, (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) as box_overlap
   from cb a join cb b on a.image_id = b.image_id and a.label < b.label and least(a.y1, b.y1) > greatest(a.y0, b.y0) and least(a.x1, b.x1) > greatest(a.x0, b.x0)""")
def _(t):
    return ov.box_pairs(mk.boxes(candidates(t)))


@query("j23_mask_overlaps", f"""with {CAND}, o as (select a.image_id, a.label as i, b.label as j, count(*) as n_px from cp a join cp b using (image_id, y, x) where a.label < b.label group by 1, 2, 3)
   select o.*, {r('n_px / (a.area + b.area - n_px)')} as iou, {r('n_px / least(a.area, b.area)')} as iomin from o join cb a on a.image_id = o.image_id and a.label = i join cb b on b.image_id = o.image_id and b.label = j""")
def _(t):
    return ov.self_overlaps(candidates(t)).select("image_id", "i", "j", "n_px", rnd("iou").alias("iou"), rnd("iomin").alias("iomin"))


STACK = TRUTH + """, st as (select image_id // 4 as volume, image_id % 4 as z, y, x, label from pt)"""


@query("j21_slice_overlap", f"""with {STACK}, ar as (select volume, z, label, count(*) as area from st group by 1, 2, 3)
   select o.*, a.area as area_a, b.area as area_b, {r('n_px / (a.area + b.area - n_px)')} as iou from (select a.volume, a.z, a.label as a_label, b.label as b_label, count(*) as n_px from st a join st b on a.volume = b.volume and b.z = a.z + 1 and a.y = b.y and a.x = b.x group by 1, 2, 3, 4) o
   join ar a on a.volume = o.volume and a.z = o.z and a.label = a_label join ar b on b.volume = o.volume and b.z = o.z + 1 and b.label = b_label""")
def _(t):
    return ov.consecutive_overlap(stack(t), ["volume"]).withColumn("iou", rnd("iou"))


def stack(t: Tables) -> DataFrame:
    """Four consecutive images are the slices of one volume."""
    return runs(t).select(F.floor(F.col("image_id") / 4).cast("long").alias("volume"), (F.col("image_id") % 4).alias("z"), "y", "x0", "x1", "label")
