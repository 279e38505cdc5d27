import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytomill.operators import graph as gr
from cytomill.operators import masks as mk
from cytomill.operators import matching as mt
from cytomill.operators import overlap as ov
from cytomill.operators import spatial as sp
from cytomill.operators import volume as vo

RUN = "image_id long, y long, x0 long, x1 long, label long"


def rect(img, label, y0, x0, h, w):
    return [(img, y, x0, x0 + w, label) for y in range(y0, y0 + h)]


def frame(spark, *rects):
    return spark.createDataFrame([r for rs in rects for r in rs], RUN)


def iou(a, b):
    ra, rb = {"label": "a_label", "area": "area_a"}, {"label": "b_label", "area": "area_b"}
    return ov.iou_pairs(ov.run_overlap(a, b), area_a=mk.areas(a).withColumnsRenamed(ra), area_b=mk.areas(b).withColumnsRenamed(rb))


def test_inclusive_box(spark):
    b = mk.inclusive_boxes(frame(spark, rect(0, 1, 7, 3, 2, 2))).first()
    assert [b["x0"], b["y0"], b["x1"], b["y1"]] == [3, 7, 4, 8]


def test_long_runs_cross_bins(spark):
    a, b = frame(spark, rect(0, 1, 0, 0, 1, 500)), frame(spark, rect(0, 2, 0, 30, 1, 400))
    assert ov.run_overlap(a, b).first()["n_px"] == 400


def test_exact_half_split_counts_once(spark):
    truth, pred = frame(spark, rect(0, 1, 0, 0, 4, 8)), frame(spark, rect(0, 1, 0, 0, 4, 4), rect(0, 2, 0, 4, 4, 4))
    t = mt.precision_table(iou(truth, pred), mt.object_counts(truth, "n_true"), mt.object_counts(pred, "n_pred"), [0.5]).first()
    assert (t["tp"], t["fp"], t["fn"]) == (1, 1, 0)


def test_images_without_one_side(spark):
    truth, pred = frame(spark, rect(0, 1, 0, 0, 4, 4), rect(1, 1, 0, 0, 2, 2)), frame(spark, rect(0, 1, 0, 0, 4, 4), rect(2, 1, 0, 0, 2, 2))
    t = {r["image_id"]: r for r in mt.precision_table(iou(truth, pred), mt.object_counts(truth, "n_true"), mt.object_counts(pred, "n_pred"), [0.5]).collect()}
    assert [(t[i]["tp"], t[i]["fp"], t[i]["fn"]) for i in range(3)] == [(1, 0, 0), (0, 0, 1), (0, 1, 0)]


@pytest.fixture(scope="module")
def random_pairs(spark):
    rng = np.random.default_rng(11)
    rows = []
    for img in range(6):
        for a in range(1, 6):
            for b in range(1, 6):
                if rng.random() < 0.55:
                    n = int(rng.integers(1, 60))
                    rows.append((img, a, b, n, round(float(rng.random() * 0.49), 6)))
    return rows, spark.createDataFrame(rows, "image_id long, a_label long, b_label long, n_px long, iou double")


def test_assignment_equals_brute_force(random_pairs):
    rows, df = random_pairs
    got = {r["image_id"]: r["s"] for r in mt.assigned_pairs(df).groupBy("image_id").agg(F.sum("iou").alias("s")).collect()}
    for img in range(6):
        w = np.zeros((5, 5))
        for i, a, b, _, v in rows:
            if i == img:
                w[a - 1, b - 1] = v
        assert got[img] == pytest.approx(max(sum(w[k, p[k]] for k in range(5)) for p in itertools.permutations(range(5))))


def test_greedy_equals_sequential_rule(random_pairs):
    rows, df = random_pairs
    want = set()
    for img in range(6):
        free = set(range(1, 6))
        for a in range(1, 6):
            cand = [(v, -b) for i, x, b, _, v in rows if i == img and x == a and b in free and v >= 0.2]
            if cand:
                b = -max(cand)[1]
                want.add((img, a, b))
                free.discard(b)
    assert {(r["image_id"], r["a_label"], r["b_label"]) for r in mt.greedy_matches(df, 0.2).collect()} == want


def test_components_chain_cycle_and_loners(spark):
    e = [(i, i + 1) for i in range(1000)] + [(2000, 2001), (2001, 2002), (2002, 2000)]
    nodes = [(i,) for i in list(range(1001)) + [2000, 2001, 2002, 5000]]
    got = {r["node"]: r["component"] for r in gr.components(spark.createDataFrame(e, "src long, dst long"), spark.createDataFrame(nodes, "node long")).collect()}
    assert all(got[i] == 0 for i in range(1001)) and {got[i] for i in (2000, 2001, 2002)} == {2000} and got[5000] == 5000


def _brute_knn(pts, k):
    out = set()
    for i, x, y in pts:
        d = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in pts if j != i)
        out |= {(i, j) for _, j in d[:k]}
    return out


@pytest.mark.parametrize("k", [1, 4])
def test_knn_with_clusters_and_duplicates(spark, k):
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.normal(0, 0.001, (60, 2)), rng.uniform(-50, 50, (40, 2)), np.repeat([[7.0, 7.0]], 8, axis=0)])
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    got = {(r["src"], r["dst"]) for r in sp.knn_edges(spark.createDataFrame(pts, "id long, x double, y double"), k).collect()}
    assert got == _brute_knn(pts, k)


def test_knn_with_fewer_points_than_k(spark):
    pts = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 5.0, 5.0)]
    assert sp.knn_edges(spark.createDataFrame(pts, "id long, x double, y double"), 15).count() == 6


def test_moran_against_dense_matrix(spark):
    rng = np.random.default_rng(4)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((40, 2)))]
    p = spark.createDataFrame(pts, "id long, x double, y double")
    e = sp.knn_edges(p, 3).cache()
    w = np.zeros((40, 40))
    for r in e.collect():
        w[r["src"], r["dst"]] = 1
    x = rng.integers(0, 3, 40).astype(float)
    t = spark.createDataFrame([(i, "g", int(v)) for i, v in enumerate(x) if v], "cell_id long, gene string, cnt long")
    z = x - x.mean()
    m = sp.morans_i(t, e, p).first()
    assert m["morans_i"] == pytest.approx(40 * z @ w @ z / (w.sum() * (z**2).sum()))
    sym = w + w.T
    s1, s2, b2, n, s0 = 0.5 * (sym**2).sum(), ((w.sum(0) + w.sum(1)) ** 2).sum(), (z**4).mean() / (z**2).mean() ** 2, 40, w.sum()
    var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)) / ((n - 1) * (n - 2) * (n - 3) * s0**2) - 1 / (n - 1) ** 2
    assert sp.morans_i(t, e, p, textbook=True).first()["variance"] == pytest.approx(var)


def _stack(spark, skip=()):
    one = [(1, 2, 2, 4, 5), (2, 10, 12, 6, 3), (3, 20, 3, 4, 9)]
    return spark.createDataFrame([(0, z, y, x0, x0 + w, l + 10 * z) for z in range(5) if z not in skip for l, y0, x0, h, w in one for y in range(y0, y0 + h)],
                                 "volume long, z long, y long, x0 long, x1 long, label long")


@pytest.mark.parametrize("join", [vo.stitch_slices, vo.merge_slices])
def test_identical_slices_share_ids(spark, join):
    ids = join(_stack(spark)).groupBy("z").agg(F.sort_array(F.collect_set("object_id")).alias("s")).select("s").distinct().collect()
    assert len(ids) == 1 and len(ids[0]["s"]) == 3


def test_gap_is_closed(spark):
    px = mk.run_pixels(_stack(spark, skip=(2,)))
    filled = vo.close_gaps(px, 1)
    gap = filled.where("z = 2")
    assert gap.count() == 20 + 18 + 36 and filled.select("label").distinct().count() == 15
    ids = vo.merge_slices(mk.pixel_runs(filled, ["volume", "z"])).groupBy("z").agg(F.countDistinct("object_id").alias("n")).collect()
    assert sorted((r["z"], r["n"]) for r in ids) == [(z, 3) for z in range(5)]


def test_fill_holes_fills_only_enclosed_background(spark):
    ring = [(0, 0, 0, 5, 1)] + [(0, y, 0, 1, 1) for y in (1, 2, 3)] + [(0, y, 4, 5, 1) for y in (1, 2, 3)] + [(0, 4, 0, 5, 1)]
    cup = [(0, 10, 0, 1, 2), (0, 10, 4, 5, 2), (0, 11, 0, 1, 2), (0, 11, 4, 5, 2), (0, 12, 0, 5, 2)]
    inner = [(0, 2, 2, 3, 3)]
    a = {r["label"]: r["area"] for r in mk.areas(vo.fill_holes(frame(spark, ring, cup, inner), 1)).collect()}
    assert a == {1: 24, 2: 9, 3: 1}


def test_suppression_is_greedy_by_score(spark):
    c = frame(spark, rect(0, 1, 0, 0, 10, 10), rect(0, 2, 0, 2, 10, 10), rect(0, 3, 0, 4, 10, 10), rect(0, 4, 50, 50, 9, 9))
    scored = mk.areas(c).withColumn("score", F.element_at(F.array(F.lit(0.8), F.lit(0.9), F.lit(0.7), F.lit(0.1)), F.col("label").cast("int")))
    assert sorted(r["label"] for r in vo.suppress(scored, ov.self_overlaps(c), 0.4, 10).collect()) == [2, 4]
    low = scored.withColumn("score", F.when(F.col("label") == 2, 0.1).otherwise(F.col("score")))
    assert sorted(r["label"] for r in vo.suppress(low, ov.self_overlaps(c), 0.5, 10).collect()) == [1, 3, 4]


@pytest.mark.parametrize("exactly_one", [True, False])
def test_boundary_scores_do_not_depend_on_blocks(spark, exactly_one):
    truth = mk.run_pixels(frame(spark, rect(0, 1, 0, 0, 9, 8), rect(0, 2, 14, 11, 12, 20)))
    pred = mk.run_pixels(frame(spark, rect(0, 1, 1, 2, 9, 8), rect(0, 2, 12, 9, 12, 21)))
    score = lambda block: [tuple(r) for r in mt.boundary_scores(truth, pred, [0.1, 0.6], 27, 33, exactly_one, block=block).orderBy("scale").collect()]
    assert len(score(256)) == 2 and score(8) == score(256)


def test_covered_masks_drop_in_size_order(spark):
    c = frame(spark, rect(0, 1, 0, 0, 10, 10), rect(0, 2, 1, 1, 3, 3), rect(0, 3, 8, 8, 6, 6))
    assert sorted({r["label"] for r in vo.drop_covered(c).collect()}) == [1, 3]


def test_covered_masks_count_their_own_pixels_once(spark):
    twice = rect(0, 1, 0, 0, 4, 4)
    c = frame(spark, twice, twice, rect(0, 2, 3, 3, 9, 9))  # one pixel of mask 1 is covered by another mask
    assert {r["label"] for r in vo.drop_covered(c).collect()} == {1, 2}
    assert "InPandas" not in vo.drop_covered(c)._jdf.queryExecution().executedPlan().toString()


def test_rasterize_overwrites_and_clips(spark):
    v = [(0, "a", 0, 1.0, 1.0), (0, "a", 1, 6.0, 1.0), (0, "a", 2, 6.0, 5.0), (0, "a", 3, 1.0, 5.0),
         (0, "b", 4, 4.0, 3.0), (0, "b", 5, 20.0, 3.0), (0, "b", 6, 20.0, 9.0), (0, "b", 7, 4.0, 9.0)]
    px = vo.rasterize(spark.createDataFrame(v, "image_id long, cell_id string, ord long, x double, y double"), 8, 8)
    got = {r["label"]: r["n"] for r in px.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {1: 5 * 4 - 2 * 2, 2: 4 * 5}


def test_rle_sums_to_image_and_round_trips(spark):
    c = mk.rle_column_major(mk.run_pixels(frame(spark, rect(0, 1, 0, 0, 3, 2), rect(0, 2, 4, 5, 2, 4))), 8, 9)
    for r in c.collect():
        assert sum(r["counts"]) == 72
        flat = np.repeat(np.arange(len(r["counts"])) % 2, r["counts"]).reshape(9, 8).T
        assert flat.sum() == (6 if r["label"] == 1 else 8)
    assert {r["label"]: r["counts"][0] for r in c.collect()} == {1: 0, 2: 44}


def test_points_on_edges(spark):
    mask = frame(spark, rect(0, 7, 0, 0, 4, 4))
    p = spark.createDataFrame([(0, 3, 3), (0, 4, 3), (0, 9, 9), (0, -2, 0)], "image_id long, y long, x long")
    clip = ov.assign_points(ov.place_points(p, "clip", 4, 4), mask)
    assert [r["label"] for r in clip.collect()] == [7, 7, 7, 7]
    assert ov.unassigned_fraction(p, mask, 4, 4).first()["n_points"] == 1


def test_tiles_cover_and_blocks_merge(spark):
    starts = spark.range(1).select(vo.tile_starts(512, 256, 0.0).alias("s")).first()["s"]
    assert starts == [0, 256]
    img = spark.createDataFrame([(0, 512, 512)], "image_id long, height int, width int")
    assert vo.make_tiles(img, 256, 0.0).count() == 4
    px = mk.run_pixels(frame(spark, rect(0, 1, 3, 3, 20, 20), rect(0, 2, 30, 1, 2, 2)))
    px = px.withColumn("gid", (F.floor(F.col("y") / 8) * 100 + F.floor(F.col("x") / 8)) * 10 + F.col("label"))
    got = vo.merge_blocks(px.withColumnRenamed("label", "truth"), 8)
    assert sorted((r["truth"], r["label"]) for r in got.select("truth", "label").distinct().collect()) == [(1, 1), (2, 2)]


def test_labels_with_gaps_renumber(spark):
    m = frame(spark, rect(0, 1, 0, 0, 2, 2), rect(0, 3, 5, 0, 2, 2), rect(0, 7, 9, 0, 5, 5), rect(1, 4, 0, 0, 2, 2))
    got = mk.areas(mk.relabel(m)).orderBy("image_id", "label").collect()
    assert [(r["image_id"], r["label"], r["area"]) for r in got] == [(0, 1, 4), (0, 2, 4), (0, 3, 25), (1, 1, 4)]


def test_hull_of_an_l_shape(spark):
    m = frame(spark, rect(0, 1, 0, 0, 4, 1) + rect(0, 1, 4, 0, 1, 5))
    s = mk.solidity(m).first()
    assert (s["area"], s["hull_area"]) == (9, 25 - 8)


def _closed_by_hand(stack, g):
    """Gap closing of a small label array (z, y, x), step by step on arrays."""
    import numpy as np

    n, (h, w) = len(stack), stack[0].shape
    fg = stack > 0
    grown = np.array([fg[max(0, z - g) : z + g + 1].any(0) for z in range(n)])
    out, top = np.zeros_like(stack), 0
    for z in range(n):
        if z < g or z >= n - g:
            names = {v: (1, v, 0) for v in np.unique(stack[z]) if v}
            key = [[names.get(v) for v in row] for row in stack[z]]
        else:
            full = grown[z - g : z + g + 1].all(0)
            part, seen = np.full((h, w), -1), 0
            for y in range(h):
                for x in range(w):
                    if full[y, x] and part[y, x] < 0:
                        todo = [(y, x)]
                        part[y, x] = seen
                        while todo:
                            a, b = todo.pop()
                            for c in range(max(0, a - 1), min(h, a + 2)):
                                for d in range(max(0, b - 1), min(w, b + 2)):
                                    if full[c, d] and part[c, d] < 0:
                                        part[c, d] = seen
                                        todo.append((c, d))
                        seen += 1
            inside = [set(np.unique(stack[z][part == k])) - {0} for k in range(seen)]
            keep = set().union(*[s for s in inside if len(s) > 1]) if seen else set()
            key = [[(1, stack[z][y, x], 0) if stack[z][y, x] in keep else (0, part[y, x], 0) if part[y, x] >= 0 and len(inside[part[y, x]]) <= 1 else None for x in range(w)] for y in range(h)]
        order = sorted({k for row in key for k in row if k})
        for y in range(h):
            for x in range(w):
                if key[y][x]:
                    out[z, y, x] = top + order.index(key[y][x]) + 1
        top += len(order)
    return out


@pytest.mark.parametrize("g", [1, 2])
def test_gap_closing_by_hand(spark, g):
    import numpy as np

    r = np.random.default_rng(g)
    stack = np.zeros((9, 12, 12), int)
    for k in range(30):
        z, y, x = r.integers(9), r.integers(9), r.integers(9)
        stack[z, y : y + r.integers(1, 4), x : x + r.integers(1, 4)] = k % 7 + 1
    stack[8, 0, 0] = 9  # the last slice is seen
    rows = [(0, int(z), int(y), int(x), int(v)) for (z, y, x), v in np.ndenumerate(stack) if v]
    got = np.zeros_like(stack)
    for p in vo.close_gaps(spark.createDataFrame(rows, "volume long, z long, y long, x long, label long"), g).collect():
        got[p.z, p.y, p.x] = p.label
    assert (got == _closed_by_hand(stack, g)).all()


def test_overlapping_masks_stay_apart(spark):
    runs = spark.createDataFrame([(0, 1, 0, 5, 1), (0, 1, 3, 8, 2), (0, 2, 0, 5, 1), (0, 1, 0, 5, 3)], "image_id long, y long, x0 long, x1 long, label long")
    from cytomill.operators.graph import run_components

    got = run_components(runs)
    assert got.count() == 4 and got.select("component").distinct().count() == 3


def test_regions_of_one_block_need_no_rounds(spark, monkeypatch):
    r = random.Random(2)
    rows = [(0, y, x, x + r.randint(1, 3), r.choice([1, 1, 2])) for y in range(20) for x in range(0, 90, 3) if r.random() < 0.6]
    seen, joined = [], gr.components
    monkeypatch.setattr(gr, "components", lambda e, *a: (seen.append(e.count()), joined(e, *a))[1])
    for diagonal, same, band, bins in ((False, True, 64, 16), (True, False, 7, 1)):
        top = {(y, x): (y, x, label) for _, y, x, _, label in rows}
        for _ in rows:
            before = dict(top)
            for _, y, a, b, label in rows:
                for _, _, c, d, other in (q for q in rows if q[1] == y + 1):
                    if a - diagonal < d and c < b + diagonal and (label == other or not same):
                        top[y, a] = top[y + 1, c] = min(top[y, a], top[y + 1, c])
            if top == before:
                break
        df = spark.createDataFrame(rows, "image_id long, y long, x0 long, x1 long, label long")
        got = gr.run_components(df, diagonal=diagonal, same_label=same, band=band, bins=bins).collect()
        assert {(q.y, q.x0): tuple(q.component)[1:] for q in got} == top and len(got) == len(rows)
    assert seen[0] == 0 < seen[1]


def test_large_slices_and_labels_stay_apart(spark):
    runs = spark.createDataFrame([(0, z, y, 0, 4, label) for z, label in ((0, 1 << 23), (1, (1 << 23) + 1), (70000, 1)) for y in (0, 1)], "volume long, z long, y long, x0 long, x1 long, label long")
    assert vo.stitch_slices(runs).select("object_id").distinct().count() == 2


def test_attach_wants_one_row(spark):
    from cytomill.operators.ordered import attach

    one = spark.range(1).select(F.lit(5).alias("v"))
    assert [r.v for r in attach(spark.range(2), one).collect()] == [5, 5]
    for n in (0, 3):
        with pytest.raises(Exception, match="one row"):
            attach(spark.range(2), spark.range(n).withColumnRenamed("id", "v")).collect()
