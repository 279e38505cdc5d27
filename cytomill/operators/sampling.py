"""Reproducible samples and crops. Every random number is a hash of the row key and a seed, so a
re-run task draws the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytomill.operators import masks as mk
from cytomill.operators.ordered import smallest, top_k, unfolded

IMG = ("image_id",)


def unit_hash(key: Column, seed: int) -> Column:
    """Uniform number in (0, 1) from the first 52 bits of md5(key|seed)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def weighted_sample(df: DataFrame, key: str, weight: Column, n: int, seed: int) -> DataFrame:
    """n rows without replacement with chance proportional to weight: smallest -ln(u) / w."""
    return smallest(df.withColumn("priority", -F.log(unit_hash(F.col(key), seed)) / weight), ["priority", key], n)


def capped_per_group(df: DataFrame, group: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    """At most n hash-ordered rows per data set; the limit is applied on the map side too."""
    d = df.withColumn("__u", unit_hash(F.col(key), seed))
    return top_k(d, group, [F.col("__u"), F.col(key)], n, "__r").drop("__u", "__r")


def seeded_subset(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n hash-chosen rows."""
    return smallest(df.withColumn("__u", unit_hash(F.col(key), seed)), ["__u", key], n).drop("__u")


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    return top_k(df, group, [F.col(c) for c in order], n, "__r").drop("__r")


def stride(df: DataFrame, keys: Sequence[str], order: str, step: int) -> DataFrame:
    """Every step-th row by ascending unique `order`."""
    from cytomill.operators.ordered import ordinal

    return ordinal(df, keys, order, "__r").where((F.col("__r") - 1) % step == 0).drop("__r", "__r_of")


def busiest_tiles(runs: DataFrame, tile: int, k: int, img: Sequence[str] = IMG) -> DataFrame:
    """The k tiles per image with the most objects; tiles without any do not occur."""
    px = runs.select(*img, "label", F.floor(F.col("y") / tile).alias("ty"), F.explode(F.sequence(F.floor(F.col("x0") / tile), F.floor((F.col("x1") - 1) / tile))).alias("tx"))
    n = px.groupBy(*img, "ty", "tx").agg(F.countDistinct("label").alias("n_objects"))
    return top_k(n, img, [F.desc("n_objects"), F.col("ty"), F.col("tx")], k)


def positive_prompts(px: DataFrame, n: int, seed: int, img: Sequence[str] = IMG) -> DataFrame:
    """n hash-chosen pixels inside each object."""
    key = F.concat_ws(",", *img, "label", "y", "x")
    return top_k(px.withColumn("__u", unit_hash(key, seed)), [*img, "label"], [F.col("__u"), F.col("y"), F.col("x")], n, "__r").drop("__u", "__r")


def negative_prompts(runs: DataFrame, n: int, margin: int, seed: int, img: Sequence[str] = IMG) -> DataFrame:
    """n hash-chosen pixels per object from its box widened by `margin`, outside the object grown by one pixel."""
    b = mk.boxes(runs, img)
    near = b.select(*img, "label", F.explode(F.sequence(F.col("y0") - margin, F.col("y1") + margin - 1)).alias("y"), "x0", "x1")
    near = near.select(*img, "label", "y", F.explode(F.sequence(F.col("x0") - margin, F.col("x1") + margin - 1)).alias("x"))
    grown = mk.run_pixels(runs).select(*img, "label", F.inline(F.array(*[
        F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))
    ]))).distinct()
    free = unfolded(near).join(grown, [*img, "label", "y", "x"], "left_anti")
    return positive_prompts(free, n, seed, img)
