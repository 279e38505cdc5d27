import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytomill.functions import tails
from cytomill.operators import clusters as cl
from cytomill.operators import expression as ex
from cytomill.operators import inference as inf
from cytomill.operators import profiles as pr
from cytomill.operators import results as rs


def test_tails_known_values():
    assert tails.student_two_sided_np(np.array([2.0, 0.0, 30.0]), np.array([10.0, 5.0, 3.0])) == pytest.approx([0.07338803477074, 1.0, 8.1e-5], rel=5e-2)
    assert tails.student_two_sided_np(np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.0733880347707, rel=1e-9)
    assert tails.normal_two_sided_np(np.array([1.96]))[0] == pytest.approx(0.04999579029644, rel=1e-9)
    assert tails.hypergeom_upper_np(3, 10, 4, 5) == pytest.approx((4 * 15 + 1 * 6) / 252)
    assert tails._signed_rank_exact(0, 5) == pytest.approx(0.0625)


def test_rank_sum_counts_all_pairs(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 6, 30), rng.integers(1, 8, 25)
    rows = [("g", float(x), 1, 0) for x in a] + [("g", float(x), 0, 1) for x in b]
    r = inf.rank_sum(spark.createDataFrame(rows, "k string, v double, ca long, cb long"), ["k"], "v", "ca", "cb").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert (r["n_a"], r["n_b"], r["u"]) == (30, 25, u)
    assert 0 <= r["p"] <= 1


def test_signed_rank_exact_p(spark):
    d = [1.0, -2.0, 3.0, 4.0, 5.0, 6.0, 0.0]
    r = inf.signed_rank(spark.createDataFrame([("k", x) for x in d], "k string, d double"), ["k"], "d", exact=True).first()
    assert (r["n"], r["w_plus"], r["w_minus"]) == (6, 19.0, 2.0)
    ways = sum(sum(c) <= 2 for n in range(7) for c in itertools.combinations(range(1, 7), n))
    assert r["p"] == pytest.approx(2 * ways / 64)


def test_control_fallbacks_and_flat_scale(spark):
    """Plate A: 6 controls; plate B: 4, so it uses all controls; a constant feature falls back to std."""
    rows = [("A", i, i < 6, "f", float(i)) for i in range(9)] + [("B", 100 + i, i < 4, "f", 10.0 + i) for i in range(7)]
    rows += [("A", i, i < 6, "flat", 2.0) for i in range(9)]
    df = spark.createDataFrame(rows, "plate string, field long, ctrl boolean, feature string, value double")
    got = {(r["plate"], r["field"], r["feature"]): r["z"] for r in pr.robust_z(df, "plate", "ctrl", ["field"]).collect()}
    ca = np.arange(6.0)
    assert got[("A", 8, "f")] == pytest.approx((8 - np.median(ca)) / np.median(np.abs(ca - np.median(ca))))
    call = np.concatenate([ca, 10.0 + np.arange(4)])
    assert got[("B", 106, "f")] == pytest.approx((16 - np.median(call)) / np.median(np.abs(call - np.median(call))))
    assert got[("A", 3, "flat")] == 0.0


def test_too_few_controls_use_every_field(spark):
    rows = [("A", i, i < 2, "f", float(i * i)) for i in range(9)]
    df = spark.createDataFrame(rows, "plate string, field long, ctrl boolean, feature string, value double")
    v = np.arange(9.0) ** 2
    z = {r["field"]: r["z"] for r in pr.robust_z(df, "plate", "ctrl", ["field"]).collect()}
    assert z[8] == pytest.approx((64 - np.median(v)) / np.median(np.abs(v - np.median(v))))


def test_field_profiles_drop_small_fields_and_non_finite(spark):
    rows = [("p", "four", 1.0)] * 4 + [("p", "five", v) for v in (1.0, 2.0, float("nan"), float("inf"), 9.0)]
    got = pr.field_profiles(spark.createDataFrame(rows, "plate string, field string, x double"), ["plate", "field"], ["x"]).collect()
    assert [(r["field"], r["n_cells"], r["median"], r["mad"]) for r in got] == [("five", 5, 2.0, 1.0)]


def test_duplicate_metadata_fails(spark):
    f = spark.createDataFrame([("w",)], "well string")
    m = spark.createDataFrame([("w", "c", "m", 1.0), ("w", "d", "m", 1.0)], "well string, compound string, moa string, concentration double")
    with pytest.raises(Exception, match="duplicate metadata key"):
        pr.unified_fields(f, m, ["well"]).collect()


def test_counting_edge_cases(spark):
    rows = [("two", 1.0, 2.0), ("two", 3.0, 3.0), ("const", 5.0, 4.0), ("const", 5.0, 6.0), ("const", 5.0, 7.0), ("zero", 0.0, 3.0), ("zero", 2.0, 3.0), ("zero", 4.0, 4.0)]
    m = {r["d"]: r for r in rs.counting_errors(spark.createDataFrame(rows, "d string, gt double, pred double"), ["d"]).collect()}
    assert m["two"]["r"] == 0.0 and m["const"]["r2"] == 0.0 and m["const"]["r"] == 0.0
    assert m["zero"]["mpe"] == pytest.approx(25.0)


def test_differential_expression_needs_three_cells(spark):
    e = spark.createDataFrame([(1, "g", 2)], "cell_id long, gene string, cnt long")
    g = spark.createDataFrame([(i, "a" if i < 2 else "b") for i in range(6)], "cell_id long, group string")
    with pytest.raises(Exception, match="at least 3 cells"):
        ex.differential_expression(e, g, "a", "b", e.select("gene")).collect()


def test_matched_accuracy_is_the_best_mapping(spark):
    m = np.array([[5, 9, 1], [8, 2, 0], [3, 3, 3]])
    rows = [("k", c, str(j), int(m[c, j])) for c in range(3) for j in range(3) if m[c, j]]
    got = cl.matched_accuracy(spark.createDataFrame(rows, "k string, cluster long, class string, n long"), ["k"]).first()["accuracy"]
    assert got == pytest.approx(max(sum(m[i, p[i]] for i in range(3)) for p in itertools.permutations(range(3))) / m.sum())


def test_bootstrap_keeps_class_sizes(spark):
    df = spark.createDataFrame([(i % 3, "a" if i < 40 else "b") for i in range(100)], "cluster long, class string")
    b = cl.bootstrap_counts(df, "cluster", "class", 20)
    sizes = b.groupBy("replicate", "class").agg(F.sum("n").alias("n")).select("class", "n").distinct().collect()
    assert {(r["class"], r["n"]) for r in sizes} == {("a", 40), ("b", 60)}
    assert b.orderBy("replicate", "class", "cluster").collect() == cl.bootstrap_counts(df, "cluster", "class", 20).orderBy("replicate", "class", "cluster").collect()


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)) * [5, 3, 1, 0.2]
    out, share = cl.pca(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "v", 2)
    got = np.array([r["pc"] for r in out.orderBy("id").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = (x - x.mean(0)) @ vt[:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    assert share == pytest.approx((s**2 / (s**2).sum())[:2])
