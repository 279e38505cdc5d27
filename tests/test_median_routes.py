"""Medians of small groups come from arrays, those of large groups from buckets, with the same numbers and rows."""

from pyspark.sql import functions as F

from cytomill.operators.ordered import _large_median_mad, median_mad_columns


def _rows(spark):
    v = F.when(F.col("id") % 17 == 0, float("nan")).when(F.col("id") % 19 == 0, None).otherwise(F.col("id") * 37 % 101 / 7.0)
    g = F.when(F.col("id") % 10 == 0, None).when(F.col("id") < 400, "a").otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string")))
    return spark.range(600).select(g.alias("g"), v.alias("v"), F.when(F.col("id") < 400, F.col("id") % 3).alias("w"))


def test_routes_agree(spark):
    df = _rows(spark)
    key = lambda d: sorted(map(repr, d.select("g", "feature", "median", "mad", "n").collect()))
    want = key(_large_median_mad(df, ["g"], ["v", "w"], "n", 8))
    for most in (5, 50, 100_000):
        assert key(median_mad_columns(df, ["g"], ["v", "w"], "n", most=most)) == want


def test_small_groups_move_once(spark):
    plan = median_mad_columns(_rows(spark), ["g"], ["v", "w"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
