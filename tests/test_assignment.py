import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytomill.operators import masks as mk
from cytomill.operators import matching as mt
from cytomill.operators import pixels as px
from cytomill.operators.ordered import smallest

PAIRS = "image_id long, a_label long, b_label long, n_px long, iou double"
RUN = "image_id long, y long, x0 long, x1 long, label long"


def best_total(w):
    """Largest total over all ways to give each row its own column or none."""
    n, m = w.shape
    wide = np.hstack([w, np.zeros((n, n))])
    return max(sum(wide[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(n + m), n))


@pytest.mark.parametrize("seed", range(30))
def test_listed_pairs_equal_all_assignments(seed):
    rng = np.random.default_rng(seed)
    w = np.where(rng.random((4, 4)) < 0.6, rng.integers(1, 9, (4, 4)) / 10, 0.0)
    a, b = np.nonzero(w)
    if not len(a):
        return
    a, b = (np.unique(v, return_inverse=True)[1] for v in (a, b))
    k = mt._sparse_assignment(a, b, w[np.nonzero(w)])
    assert len(set(a[k])) == len(k) == len(set(b[k]))
    assert w[np.nonzero(w)][k].sum() == pytest.approx(best_total(w))


def chain(n, seed):
    """One component: left i touches right i and right i + 1."""
    rng = np.random.default_rng(seed)
    w = rng.integers(1, 49, (n, 2)) / 100
    rows = [(0, i, i + d, 10, float(w[i, d])) for i in range(n) for d in (0, 1)]
    return w, rows


def test_long_component_equals_dynamic_programme(spark):
    w, rows = chain(3000, 5)
    free, used = 0.0, -1.0  # best total with the next right label free or taken
    for own, next_ in w:
        free, used = max(free + own, used, free), max(free, used) + next_
    got = mt.assigned_pairs(spark.createDataFrame(rows, PAIRS)).agg(F.sum("iou")).first()[0]
    assert got == pytest.approx(max(free, used))


def test_long_component_without_settled_pairs():
    """Equal weights leave everything to the search, which stays near its start."""
    n = 20000
    a, b = np.repeat(np.arange(n), 2), np.stack([np.arange(n), np.arange(n) + 1], 1).ravel()
    k = mt._sparse_assignment(a, b, np.full(2 * n, 0.3))
    assert len(k) == n == len(set(b[k]))


def test_no_pairs_at_all(spark):
    none = spark.createDataFrame([], PAIRS)
    assert mt.assigned_pairs(none).count() == 0 and mt.greedy_matches(none, 0.2).count() == 0


def test_greedy_chain_of_rivals(spark):
    """Every left label prefers what the one before it takes."""
    rows = [(0, i, i + d, 1, 0.4 - 0.1 * d) for i in range(12) for d in (0, 1)] + [(0, 0, 5, 1, 0.45)]
    free, want = set(range(14)), set()
    for a in range(12):
        b = -max((v, -q) for _, p, q, _, v in rows if p == a and q in free)[1]
        want.add((a, b))
        free.discard(b)
    got = mt.greedy_matches(spark.createDataFrame(rows, PAIRS), 0.2)
    assert {(r["a_label"], r["b_label"]) for r in got.collect()} == want


def test_distances_of_odd_shapes(spark):
    rng = np.random.default_rng(3)
    on = rng.random((14, 17)) < 0.85
    p = spark.createDataFrame([(0, int(y), int(x), 1) for y, x in zip(*np.nonzero(on))], "image_id long, y long, x long, label long")
    edge = [(r["y"], r["x"]) for r in mk.outline_pixels(p).collect()]
    for r in mk.distance_to_outline(p).collect():
        assert r["dist2"] == min((r["y"] - y) ** 2 + (r["x"] - x) ** 2 for y, x in edge)


def test_distances_of_a_wide_object(spark):
    h, w = 21, 5000
    wide = spark.createDataFrame([(0, y, 0, w, 1) for y in range(h)], RUN)
    d = mk.distance_to_outline(mk.run_pixels(wide))
    wrong = d.where(F.col("dist2") != F.pow(F.least("x", w - 1 - F.col("x"), "y", h - 1 - F.col("y")), 2))
    assert d.count() == h * w and wrong.count() == 0


def test_matched_cells_are_summed_up(spark):
    rect = lambda img, label, y0, x0, h, w: [(img, y, x0, x0 + w, label) for y in range(y0, y0 + h)]
    a = spark.createDataFrame(rect(0, 1, 0, 0, 6, 6) + rect(0, 2, 20, 20, 6, 6) + rect(1, 1, 0, 0, 3, 3), RUN)
    b = spark.createDataFrame(rect(0, 7, 0, 1, 6, 6) + rect(0, 8, 20, 20, 6, 6), RUN)
    m = spark.createDataFrame([(0, 1, 7, 5 / 7), (0, 2, 8, 1.0)], "image_id long, a_label long, b_label long, iou double")
    s = mt.match_summary(mt.outline_distances(m, a, b), mt.object_counts(a, "n_a"), mt.object_counts(b, "n_b"))
    s = {r["image_id"]: r for r in s.collect()}
    assert s[0]["matched"] == 2 and s[0]["median_iou"] == pytest.approx(6 / 7) and s[0]["mean_boundary_distance"] == pytest.approx(0.5)
    assert (s[1]["matched"], s[1]["median_iou"], s[1]["mean_boundary_distance"]) == (0, 0.0, 0.0)
    value = lambda runs: mk.run_pixels(runs).withColumn("dna", F.col("x").cast("double"))
    cells, per = px.compare_expression(value(a), value(b), m, ["dna"])
    assert {(r["a_label"], r["b_label"]): r["abs_diff"] for r in cells.collect()} == {(1, 7): 1.0, (2, 8): 0.0}
    assert [(r["image_id"], r["n_matched"], r["median_abs_diff"]) for r in per.collect()] == [(0, 2, 0.5)]


@pytest.mark.parametrize("n", [0, 1, 250, 499, 500, 700])
def test_smallest_splits_hot_buckets(spark, n):
    values = [0.5] * 200 + [None] * 20 + [float("nan")] * 5 + [k / 1000 - 0.1 for k in range(275)]
    rows = [(k * 7919 % 500, v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, v double")
    want = [r["id"] for r in df.orderBy("v", "id").limit(n).collect()]
    assert sorted(r["id"] for r in smallest(df, ["v", "id"], n, most=8).collect()) == sorted(want)
