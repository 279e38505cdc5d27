"""Joins whose sides grow in `explode` shuffle; the planner's size estimates, which stop at the source, never broadcast them."""

from pyspark.sql import functions as F

from cytomill.operators import graph as gr
from cytomill.operators import masks as mk
from cytomill.operators import overlap as ov
from cytomill.operators import matching as mt
from cytomill.operators import pixels as px
from cytomill.operators import spatial as sp
from cytomill.operators import volume as vo
from cytomill.operators.ordered import join_on, spread
from cytomill.plans.registry import Tables
from cytomill.plans.shapes import runs


def _broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def _runs(spark, step=0):
    return spark.range(40).select(
        F.lit(1).cast("long").alias("image_id"), F.col("id").alias("y"), (F.col("id") % 7 + step).alias("x0"), (F.col("id") % 7 + 5).alias("x1"), (F.col("id") / 4).cast("long").alias("label")
    )


def test_pixel_joins_shuffle(spark):
    p = mk.run_pixels(_runs(spark)).withColumn("dna", F.col("x").cast("double"))
    areas = mk.pixel_areas(p)
    assert _broadcasts(join_on(p, areas, ["image_id", "label"])) == 0
    assert _broadcasts(px.edge_intensity(p, ["dna"])) == 0
    assert _broadcasts(px.grey_levels(p, "dna")) == 0
    assert _broadcasts(vo.face_pairs(p.withColumn("gid", F.col("label")), 4)) == 0


def test_region_joins_shuffle(spark):
    a, b = _runs(spark), _runs(spark, 1)
    assert _broadcasts(ov.run_overlap(a, b)) == 0
    assert _broadcasts(ov.self_overlaps(a.unionByName(b.withColumn("label", F.col("label") + 100)))) == 0
    assert _broadcasts(ov.assign_points(a.select("image_id", "y", F.col("x0").alias("x")), b)) == 0
    assert _broadcasts(ov.box_pairs(mk.boxes(a))) == 0


def test_components_of_stored_rounds_shuffle(spark):
    e = spark.range(50).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert _broadcasts(gr.components(e)) == 0
    assert _broadcasts(gr.run_components(_runs(spark))) == 0


def test_neighbours_and_outlines_of_stored_points_shuffle(spark):
    p = spark.range(60).select((F.col("id") % 2).alias("g"), F.col("id"), (F.col("id") * 7 % 13).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("y"))
    assert _broadcasts(sp.nearest(p, p, 3, ["g"])) == 0
    assert _broadcasts(sp.contour_distances(p, p.where("id % 3 = 0"), ["g"])) == 0
    assert _broadcasts(sp.contour_distances(p, p.where("id % 3 = 0"), ["g"], most=41)) == 0
    match = spark.createDataFrame([(1, 2, 2, 0.9)], "image_id long, a_label long, b_label long, iou double")
    assert _broadcasts(mt.outline_distances(match, _runs(spark), _runs(spark, 1))) == 0


def test_closing_of_gaps_shuffles(spark):
    px = mk.run_pixels(_runs(spark)).select(F.lit(1).cast("long").alias("volume"), (F.col("y") % 5).alias("z"), F.floor(F.col("y") / 5).alias("y"), "x", "label")
    assert _broadcasts(vo.close_gaps(px, 1)) == 0


def test_markers_are_not_shuffled_to_one_task_each(spark):
    p = mk.run_pixels(_runs(spark)).withColumn("dna", F.col("x").cast("double")).withColumn("actin", F.lit(2.0))
    long = p.select("image_id", "y", "x", "dna", "actin").unpivot(["image_id", "y", "x"], ["dna", "actin"], "marker", "value")
    markers = spark.createDataFrame([("dna", "red"), ("actin", "red"), ("actin", "blue")], "marker string, out_channel string")
    c = px.marker_composite(long, markers)
    plan = c._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "SortMergeJoin" not in plan and "hashpartitioning(marker" not in plan
    got = {(r.y, r.x, r.out_channel): r.value for r in c.collect()}
    assert got == {(r.y, r.x, o): v for r in p.select("y", "x").collect() for o, v in (("red", r.x + 2.0), ("blue", 2.0))}


def test_masks_are_drawn_by_many_tasks(spark):
    px = mk.run_pixels(runs(Tables(spark, "/root/testdata/sf0.01")))
    assert px.groupBy(F.spark_partition_id()).count().count() >= spark.sparkContext.defaultParallelism


def test_tiles_are_blended_in_tasks_of_bounded_size(spark):
    images = spark.range(12).select(F.col("id").alias("image_id"), F.lit(40).alias("height"), F.lit(40).alias("width"))
    px = mk.run_pixels(_runs(spark).drop("image_id").crossJoin(images.select("image_id"))).withColumn("v", F.col("x").cast("double"))
    tiles = vo.make_tiles(images, 8)
    whole = vo.average_tiles(vo.tile_pixels(px, tiles, 8), "v", 8)
    parts = vo.average_tiles(vo.tile_pixels(px, tiles, 8, cells=True, per_task=6), "v", 8)
    key = lambda d: sorted((r.image_id, r.y, r.x, round(r.v, 9)) for r in d.collect())
    assert key(parts) == key(whole)
    assert parts.rdd.getNumPartitions() == -(-tiles.count() // 6)
    plan = parts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(") == 2  # pixels and tiles once each


def test_faces_of_all_axes_read_the_pixels_once(spark):
    px = mk.run_pixels(_runs(spark)).withColumn("gid", F.col("label") + 1)
    met = vo.touching_faces(px, {"y": 4, "x": 4}, {"y": 40, "x": 40})
    assert "Range" not in met._jdf.queryExecution().optimizedPlan().toString()


def test_few_rows_are_exploded_by_many_tasks(spark):
    tasks = 4 * spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        images = spark.range(2000).select((F.col("id") % 400).alias("image_id")).distinct()
        assert spread(images, ["image_id"]).groupBy(F.spark_partition_id()).count().count() == tasks
        many = _runs(spark).withColumn("image_id", F.col("label") % 5)
        image = mk.run_pixels(many).withColumn("dna", F.lit(1.0))
        assert "REPARTITION_BY_NUM" in px.box_pixels(many, image, ["dna"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
