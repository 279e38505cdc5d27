"""Connected components and lineage tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomill.operators.ordered import ordinal, unfolded
from cytomill.session import cut


def _star(rows: DataFrame, own: bool) -> DataFrame:
    """Each row (u, v) with m, the smallest neighbour of u (u itself included if `own`).

    The minima are a table of their own, one row per node, so both sides of the join are plain
    shuffled inputs and adaptive execution can split the rows of a hub over many tasks.
    """
    least = rows.groupBy("u").agg(F.min("v").alias("m"))
    least = cut(least.withColumn("m", F.least("u", "m")) if own else least)
    return rows.join(unfolded(least), "u")


def components(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node id reachable, by alternating large-star and small-star.

    Runs until a round changes nothing; the edge set shrinks to stars, so rounds grow with the log
    of the longest chain. Every round reads written tables, so a lost executor repeats one round.
    Null ends are no edges.
    """
    e = cut(
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    sign, last = _signature(e), None
    while sign[0] and sign != last:
        last = sign
        # large-star: every larger neighbour of u now points at u's minimum
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_star(both, own=True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small-star: u and its smaller neighbours point at the smallest of them
        small = _star(large, own=False)
        e = cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        sign = _signature(e)
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    if nodes is None:
        nodes = edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst).alias("node"))).distinct()
    return nodes.select("node").join(unfolded(stars), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def merge_relabeling(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, new_label): components of touching labels renumbered 1..N in ascending root id."""
    comp = components(edges, nodes, src, dst)
    roots = ordinal(comp.select("component").distinct(), [], "component", "new_label").drop("new_label_of")
    return comp.join(unfolded(roots), "component").select("node", "new_label")


def lineages(tracks: DataFrame, edges: DataFrame, track: str = "track_id", parent: str = "parent", child: str = "child") -> DataFrame:
    """Root, parent and size of the lineage of every track; edges to absent tracks are dropped."""
    ids = tracks.select(F.col(track).alias("node")).distinct()
    e = edges.select(F.col(parent).alias("src"), F.col(child).alias("dst"))
    e = e.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    comp = components(e, ids)
    up = e.groupBy("dst").agg(F.min("src").alias("parent")).withColumnRenamed("dst", "node")
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n_tracks"))
    return comp.join(up, "node", "left").join(size, "component").select(
        F.col("node").alias(track), F.col("component").alias("lineage"), "parent", "n_tracks"
    )


def singletons(tracks: DataFrame, edges: DataFrame, track: str = "track_id", parent: str = "parent", child: str = "child") -> DataFrame:
    """Tracks that occur in no lineage edge."""
    used = edges.select(F.col(parent).alias(track)).union(edges.select(F.col(child).alias(track)))
    return tracks.select(track).distinct().join(used, track, "left_anti")


def _first_edges(y: np.ndarray, x0: np.ndarray, label: np.ndarray, y2: np.ndarray, x2: np.ndarray, label2: np.ndarray) -> np.ndarray:
    """For each edge between runs of neighbouring rows, a number of an edge that starts at the smallest run of its region."""
    codes, _ = pd.factorize(pd.Series(np.concatenate([label, label2])), sort=True)
    names = np.stack([np.concatenate([y, y2]), np.concatenate([x0, x2]), codes])
    order = np.lexsort(names[::-1])
    new = np.any(np.diff(names[:, order], axis=1) != 0, axis=0)
    node = np.empty(len(order), np.int64)
    node[order] = np.concatenate([[0], np.cumsum(new)])
    src, dst = np.split(node, 2)
    low, before = np.arange(int(node.max()) + 1), None
    while before is None or (low != before).any():
        before = low.copy()
        least = np.minimum(low[src], low[dst])
        for side in (src, dst):
            np.minimum.at(low, low[side], least)
            np.minimum.at(low, side, least)
        low = low[low]
    starts = np.zeros(len(low), np.int64)
    starts[src] = np.arange(len(src))  # the smallest run lies in the topmost row, so an edge starts there
    return starts[low[src]]


def run_components(
    runs: DataFrame, img: Sequence[str] = ("image_id",), diagonal: bool = False, same_label: bool = True, band: int = 64, bins: int = 16
) -> DataFrame:
    """Connected pixel regions: touching runs of neighbouring rows are edges; adds `component`.

    A run is named by (image, row, start, label), so overlapping masks stay apart unless `same_label` is off. Edges are first
    joined within blocks of `band` rows and `bins` bins of 64 pixels, as arrays of one block; only regions that share a run with
    another block are joined by rounds over tables.
    """
    from cytomill.operators.overlap import _binned

    r = runs.withColumn("rid", F.struct(*img, "y", "x0", "label"))
    reach = 1 if diagonal else 0
    # a run of row y meets a run of row y+1; 8-connectivity widens one side by a pixel each way
    a = _binned(r.withColumn("x0", F.col("x0") - reach).withColumn("x1", F.col("x1") + reach), 64)
    b = _binned(r.select(*img, (F.col("y") - 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("label").alias("l2"), F.col("rid").alias("rid2")), 64, "u0", "u1")
    e = a.join(b, [*img, "y", "__bx"]).where((F.col("x0") < F.col("u1")) & (F.col("u0") < F.col("x1")))
    if same_label:
        e = e.where(F.col("label") == F.col("l2"))
    spot = ("y", "x0", "label")
    edge = F.struct(*[F.col(f"rid.{c}").alias(c) for c in spot], *[F.col(f"rid2.{c}").alias(f"{c}_2") for c in spot])
    met = e.groupBy(*img, F.floor(F.col("y") / band).alias("__band"), F.floor(F.col("__bx") / bins).alias("__block")).agg(F.collect_list(edge).alias("__r"))

    @F.pandas_udf("array<long>")
    def solve(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series([_first_edges(*c) for c in zip(*columns, strict=True)], dtype=object)

    met = met.withColumn("__at", solve(*[F.col(f"__r.{c}") for c in (*spot, *[f"{c}_2" for c in spot])]))
    named = lambda s, tail="": F.struct(*img, *[s[f"{c}{tail}"].alias(c) for c in spot])
    first = lambda at: F.get("__r", at.cast("int"))
    pairs = F.transform("__at", lambda at, i: F.array(
        F.struct(named(F.get("__r", i)).alias("rid"), named(first(at)).alias("root")), F.struct(named(F.get("__r", i), "_2").alias("rid"), named(first(at)).alias("root"))
    ))
    local = unfolded(met.select(F.inline(F.flatten(pairs)))).groupBy("rid").agg(F.min("root").alias("root"), F.collect_set("root").alias("__roots"))
    local = unfolded(cut(local))
    links = local.where(F.size("__roots") > 1).select(F.col("root").alias("src"), F.explode("__roots").alias("dst"))
    joined = components(links).select(F.col("node").alias("root"), F.col("component").alias("__c"))
    local = local.select("rid", "root").join(unfolded(joined), "root", "left").select("rid", F.coalesce("__c", "root").alias("component"))
    return unfolded(r).join(unfolded(local), "rid", "left").withColumn("component", F.coalesce("component", "rid")).drop("rid")
