"""Shape columns, openings and nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from cytomill.operators import cells, masks, pixels, spatial


def _blob(seed, height=23, width=31):
    rng = np.random.default_rng(seed)
    a = rng.random((height, width)) < 0.6
    a[5:9, 4:20] = True
    a[6:8, 7:11] = False
    return a


def _runs(a, label):
    out = []
    for y, row in enumerate(a):
        d = np.diff(np.concatenate([[0], row.astype(int), [0]]))
        out += [(0, y + 100, int(s) + 1000, int(e) + 1000, label) for s, e in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1), strict=True)]
    return out


def _parts(a, diagonal):
    """Connected parts of a mask."""
    left, n = {tuple(p) for p in np.argwhere(a)}, 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            y, x = todo.pop()
            for dy, dx in steps:
                if (q := (y + dy, x + dx)) in left:
                    left.discard(q)
                    todo.append(q)
    return n


def _inside_hull(points, y, x):
    """Whether a place lies in the hull: no line through two points has all of them strictly on its other side."""
    for i in range(len(points)):
        d = points - points[i]
        cross = d[:, 0] * (x - points[i][1]) - d[:, 1] * (y - points[i][0])
        for j in np.flatnonzero(cross < 0):
            if (d[j, 0] * d[:, 1] - d[j, 1] * d[:, 0] >= 0).all():
                return False
    return True


def test_shape_columns_equal_brute_force(spark):
    masks = {1: _blob(1), 2: _blob(2), 3: np.ones((1, 1), bool), 4: np.ones((1, 7), bool), 5: np.eye(6, dtype=bool), 6: np.ones((9, 4), bool)}
    rows = [r for label, a in masks.items() for r in _runs(a, label)]
    got = {r["label"]: r for r in cells.shape_features(spark.createDataFrame(rows, "image_id long, y long, x0 long, x1 long, label long"), exact=True).collect()}
    for label, a in masks.items():
        ys, xs = np.nonzero(a)
        r = got[label]
        assert r["area"] == len(ys) and r["cy"] == pytest.approx(ys.mean() + 100) and r["cx"] == pytest.approx(xs.mean() + 1000)
        box = (np.ptp(ys) + 1) * (np.ptp(xs) + 1)
        assert r["extent"] == pytest.approx(len(ys) / box)
        cov = np.cov(np.stack([xs, ys]), bias=True) if len(ys) > 1 else np.zeros((2, 2))
        e = np.linalg.eigvalsh(cov)
        assert r["major_axis_length"] == pytest.approx(4 * math.sqrt(max(e[1], 0)), abs=1e-6) and r["minor_axis_length"] == pytest.approx(4 * math.sqrt(max(e[0], 0)), abs=1e-6)
        mids = np.array([(y + dy, x + dx) for y, x in zip(ys, xs, strict=True) for dy, dx in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))])
        outer = np.array([p for p in {tuple(p) for p in mids}])
        hull = sum(_inside_hull(outer, y, x) for y in range(ys.min(), ys.max() + 1) for x in range(xs.min(), xs.max() + 1)) if label > 2 else None
        if hull is not None:
            assert r["solidity"] == pytest.approx(len(ys) / hull)
        assert r["max_feret_diameter"] == pytest.approx(max(np.sqrt(((outer - p) ** 2).sum(1)).max() for p in outer))
        assert r["euler_number"] == _parts(a, True) - (_parts(np.pad(~a, 1, constant_values=True), False) - 1)
        p = np.pad(a, 2)
        edge = p & ~(np.roll(p, 1, 0) & np.roll(p, -1, 0) & np.roll(p, 1, 1) & np.roll(p, -1, 1))
        length = 0.0
        for y, x in np.argwhere(edge):
            near = edge[y - 1 : y + 2, x - 1 : x + 2].astype(int)
            s, d = near[0, 1] + near[2, 1] + near[1, 0] + near[1, 2], near[0, 0] + near[0, 2] + near[2, 0] + near[2, 2]
            length += cells.STEP.get((int(s), int(d)), 0.0)
        assert r["perimeter"] == pytest.approx(length)
    plain = {r["label"]: r for r in cells.shape_features(spark.createDataFrame(rows, "image_id long, y long, x0 long, x1 long, label long")).collect()}
    assert all(r["euler_number"] == 1 and r["max_feret_diameter"] == r["major_axis_length"] for r in plain.values())


def test_perimeter_is_the_same_in_strips():
    _, y, a, b, _ = (np.array(c) for c in zip(*_runs(_blob(3), 1), strict=True))
    assert cells._perimeter(y, a, b, 1) == pytest.approx(cells._perimeter(y, a, b))


def test_openings_skip_blocks_beyond_the_border(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    opened = pixels._opened

    def counted(*args):
        seen.add(1)
        return opened(*args)

    monkeypatch.setattr(pixels, "_opened", counted)
    px = spark.createDataFrame([(1, y, x, float(y * x)) for y in range(8) for x in range(8)], "image_id long, y long, x long, v double")
    assert len(pixels.grey_openings(px, "v", {"three": 3}, block=8).collect()) == 64
    assert seen.value == 1  # the eight blocks around the image hold copies of its border only


@pytest.mark.parametrize("block", [8, 64])
def test_openings_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 50, (21, 26)).astype(float)
    px = spark.createDataFrame([(1, y, x, float(a[y, x])) for y in range(21) for x in range(26)], "image_id long, y long, x long, v double")
    got = pixels.grey_openings(px, "v", {"three": 3, "seven": 7}, block=block).collect()
    assert len(got) == a.size
    for name, half in (("three", 1), ("seven", 3)):
        def window(m, fold, half=half):
            return np.array([[fold(m[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1]) for x in range(26)] for y in range(21)])

        want = window(window(a, np.min), np.max)
        assert all(r[name] == want[r["y"], r["x"]] for r in got)


def _brute(query, data, k):
    out = {}
    for q, x, y in query:
        d = sorted(((x - a) ** 2 + (y - b) ** 2, i) for i, a, b in data)
        out[q] = [i for _, i in d[:k]]
    return out


def test_far_outliers_keep_candidates_linear(spark):
    rng = np.random.default_rng(8)
    dense = rng.random((8000, 2)).tolist()
    far = (rng.random((150, 2)) * 1e6).tolist()
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate([*dense, *far, (1e9, 1e9)])]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    rows = spatial.candidates(df, df, 4).count()
    assert rows < 60 * 16 * len(pts)
    asked = [*pts[:60], *pts[-151:]]
    got = {}
    for r in spatial.nearest(spark.createDataFrame(asked, "id long, x double, y double"), df, 4).collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == _brute(asked, pts, 4)


def test_neighbours_within_keys_and_on_equal_places(spark):
    rng = np.random.default_rng(9)
    rows = [(k, i, float(x), float(y)) for k in range(3) for i, (x, y) in enumerate((rng.integers(0, 5, (60, 2)) * 10.0**k).tolist())]
    df = spark.createDataFrame(rows, "g long, id long, x double, y double")
    got = {}
    for r in spatial.nearest(df, df, 3, ["g"]).collect():
        got.setdefault((r["g"], r["src"]), {})[r["rank"]] = r["dst"]
    for k in range(3):
        mine = [(i, x, y) for g, i, x, y in rows if g == k]
        assert {q: [got[k, q][i] for i in (1, 2, 3)] for q, _, _ in mine} == _brute(mine, mine, 3)


@pytest.mark.parametrize("most", [1_000, 45, 0])
def test_contours_of_both_routes(spark, most):
    rng = np.random.default_rng(11)
    sets = {(g, k): rng.integers(0, 40, (n, 2)).astype(float) for g, ns in enumerate([(12, 9), (30, 25), (1, 3), (0, 4)]) for k, n in enumerate(ns)}
    side = lambda k: spark.createDataFrame(
        [(g, i, *map(float, p)) for (g, s), ps in sets.items() if s == k for i, p in enumerate(ps)] + [(None, 0, 1.0, 1.0), (0, 99, None, 1.0)], "g long, id long, x double, y double"
    )
    got = {r["g"]: (r["average"], r["hausdorff"]) for r in spatial.contour_distances(side(0), side(1), ["g"], most=most).collect()}
    assert set(got) == {0, 1, 2}
    for g, (average, hausdorff) in got.items():
        d = np.hypot(*(np.subtract.outer(sets[g, 0][:, c], sets[g, 1][:, c]) for c in (0, 1)))
        d = np.concatenate((d.min(axis=1), d.min(axis=0)))
        assert (average, hausdorff) == (pytest.approx(d.mean()), pytest.approx(d.max()))


def test_pairs_across_bands_and_odd_pixels(spark):
    rng = np.random.default_rng(5)
    rows = [(g, label, int(y), int(x), int(v)) for g, label in ((0, 1), (0, 2), (3, 1)) for (y, x), v in zip(rng.integers(-9, 40, (300, 2)), rng.integers(0, 4, 300))]
    rows += [(0, 7, 0, 0, 5), (0, 8, 0, 0, 1), (0, 8, 3, 0, 300)]
    grey = spark.createDataFrame([*rows, (0, None, 0, 0, 1)], "image_id long, label long, y long, x long, g long").repartition(3)
    want = {}
    for k, (dy, dx) in enumerate(((0, 3), (3, 3), (3, 0), (3, -3))):
        for a in rows:
            for b in rows:
                if a[:2] == b[:2] and (a[2] + dy, a[3] + dx) == b[2:4] and a[4] and b[4]:
                    for i, j in ((a[4], b[4]), (b[4], a[4])):
                        want[*a[:2], k, i, j] = want.get((*a[:2], k, i, j), 0) + 1
    pairs = pixels.cooccurrence(grey, 3, band=4)
    assert {(r["image_id"], r["label"], r["direction"], r["i"], r["j"]): r["n"] for r in pairs.collect()} == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("Initial Plan")[-1].count("Exchange hashpartitioning(") == 2  # the pixels and the counts


def test_object_pixels_of_blocks(spark):
    """Masks that overlap and cross blocks, an image with gaps."""
    a = [(0, y, 3 + y % 3, 17 - y % 2, 1) for y in range(2, 19)] + [(0, y, 10, 14 + y % 4, 2) for y in range(15, 24)] + [(4, 0, 0, 9, 1), (0, 30, 2, 4, 1)]
    runs = spark.createDataFrame(a, "image_id long, y long, x0 long, x1 long, label long")
    rng = np.random.default_rng(8)
    places = [(g, y, x) for g in (0, 4) for y in range(31) for x in range(26) if rng.random() < 0.95]
    image = spark.createDataFrame([(*p, float(v)) for p, v in zip(places, rng.integers(0, 50, len(places)))], "image_id long, y long, x long, dna double")
    key = ["image_id", "label", "y", "x"]
    got = pixels.object_pixels(runs, image, ["dna"], "dna", {"o": 3}, block=8, per_task=2).toPandas().sort_values(key).reset_index(drop=True)
    boxes = pixels.box_pixels(runs, image, ["dna"]).toPandas().sort_values(key).reset_index(drop=True)
    assert got[[*key, "dna"]].equals(boxes[[*key, "dna"]])
    own = masks.run_pixels(runs).join(image, ["image_id", "y", "x"]).select(*key)
    tuples = lambda d: set(map(tuple, d[key].to_numpy().tolist()))
    assert tuples(got[got["__in"]]) == tuples(own.toPandas())
    assert tuples(got[got["__edge"]]) == tuples(masks.outline_pixels(own).toPandas())
    opened = pixels.grey_openings(image, "dna", {"o": 3}).toPandas().set_index(["image_id", "y", "x"])["o"]
    assert got["o"].tolist() == [opened[r] for r in zip(got["image_id"], got["y"], got["x"])]


def test_field_features_read_the_image_once(spark, monkeypatch):
    plans = []

    def noted(df, cut=cells.cut):
        plans.append(df)
        return cut(df)

    monkeypatch.setattr(cells, "cut", noted)
    image = spark.range(0, 1234).select(F.lit(0).cast("long").alias("image_id"), F.floor(F.col("id") / 40).alias("y"), (F.col("id") % 40).alias("x"), (F.col("id") % 37).cast("double").alias("dna"))
    runs = spark.createDataFrame([(0, y, 3, 20, 1) for y in range(2, 15)], "image_id long, y long, x0 long, x1 long, label long")
    plans.append(cells.field_features(runs, image, ["dna"], "dna"))
    assert sum(p._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 1234") for p in plans) == 1
