"""Label masks derived from the part table, so that they grow with it.

256 parts make one image of 16 x 16 slots of 16 pixels; every part draws one object in its slot.
The second method shifts and resizes the same objects and misses the largest ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomill.operators.ordered import unfolded
from cytomill.plans.registry import Tables

SIDE = 256


def _object_rows(t: Tables, method: str) -> DataFrame:
    # a small file is one split, whose task alone would draw all pixels; a given number is not merged again
    p = t.part.repartition(4 * t.spark.sparkContext.defaultParallelism, "p_partkey")
    k, s = F.col("p_partkey"), F.col("p_size")
    slot = k % 256
    gx, gy = slot % 16, F.floor(slot / 16)
    if method == "truth":
        x0, y0, w, h = gx * 16 + 1 + s % 3, gy * 16 + 1 + s % 2, 4 + s % 9, 3 + (s * 7) % 10
    else:
        p = p.where(F.col("p_size") <= 47)
        x0, y0, w, h = gx * 16 + 1 + (s + k) % 3, gy * 16 + 1 + (s + k) % 2, 4 + (s + F.floor(F.col("p_retailprice"))) % 9, 3 + (s * 7 + F.floor(k / 7)) % 10
    return p.select(
        F.floor(k / 256).cast("long").alias("image_id"), (slot + 1).cast("long").alias("label"),
        x0.cast("long").alias("x0"), y0.cast("long").alias("y0"), w.cast("long").alias("w"), h.cast("long").alias("h"),
    )


def runs(t: Tables, method: str = "truth") -> DataFrame:
    """mask_run(image_id, y, x0, x1, label): each third row is one or two pixels shorter."""
    o = _object_rows(t, method)
    rows = o.select("image_id", "label", "x0", "y0", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)).alias("j"))
    return unfolded(rows).select(
        "image_id", (F.col("y0") + F.col("j")).alias("y"), "x0", (F.col("x0") + F.col("w") - F.col("j") % 3).alias("x1"), "label"
    )


def intensity(px: DataFrame) -> DataFrame:
    """Two synthetic channels per mask pixel (columns dna, actin)."""
    x, y, l = F.col("x"), F.col("y"), F.col("label")
    return px.withColumn("dna", ((x * 7 + y * 13 + l * 5) % 101).cast("double")).withColumn("actin", ((x * x + y * y * 3 + l) % 97).cast("double"))


TRUTH = """obj_t as (select p_partkey // 256 as image_id, p_partkey % 256 + 1 as label, (p_partkey % 256) % 16 * 16 + 1 + p_size % 3 as x0,
   (p_partkey % 256) // 16 * 16 + 1 + p_size % 2 as y0, 4 + p_size % 9 as w, 3 + (p_size * 7) % 10 as h from part),
 rt as (select image_id, y0 + j as y, x0, x0 + w - j % 3 as x1, label from (select *, unnest(range(0, h)) as j from obj_t)),
 pt as (select image_id, y, unnest(range(x0, x1)) as x, label from rt)"""
PRED = """obj_p as (select p_partkey // 256 as image_id, p_partkey % 256 + 1 as label, (p_partkey % 256) % 16 * 16 + 1 + (p_size + p_partkey) % 3 as x0,
   (p_partkey % 256) // 16 * 16 + 1 + (p_size + p_partkey) % 2 as y0, 4 + (p_size + floor(p_retailprice)::bigint) % 9 as w,
   3 + (p_size * 7 + p_partkey // 7) % 10 as h from part where p_size <= 47),
 rp as (select image_id, y0 + j as y, x0, x0 + w - j % 3 as x1, label from (select *, unnest(range(0, h)) as j from obj_p)),
 pp as (select image_id, y, unnest(range(x0, x1)) as x, label from rp)"""
CHANNELS = """pc as (select *, ((x * 7 + y * 13 + label * 5) % 101)::double as dna, ((x * x + y * y * 3 + label) % 97)::double as actin from pt)"""
EDGE = """nb as (select a.*, (select count(*) from (values (1, 0), (-1, 0), (0, 1), (0, -1)) d(dy, dx) where exists (select 1 from pt b where b.image_id = a.image_id
    and b.y = a.y + d.dy and b.x = a.x + d.dx and b.label = a.label)) as same4 from pt a)"""
