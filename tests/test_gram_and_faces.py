"""Gram matrices, correlated features and shrunk block faces against brute force."""

import numpy as np

from cytomill.operators import gram, volume


def test_gram_rows_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(gram, "BAND", 12)
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=(200, 5)), rng.integers(0, 3, 200)
    df = spark.createDataFrame([(int(k) if k else None, v.tolist()) for k, v in zip(g, x, strict=True)], "group long, x array<double>").repartition(4)
    got = {}
    for r in gram.gram_rows(df, 5).collect():
        got.setdefault(r["group"], np.zeros((5, 5)))[r["first"] : r["first"] + len(r["band"]) // 40] = np.frombuffer(r["band"]).reshape(-1, 5)
    assert set(got) == {None, 1, 2}
    for k, m in got.items():
        mine = x[g == (k or 0)]
        assert np.allclose(m, mine.T @ mine)


def test_selection_equals_a_plain_scan(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 6)) + 1e6  # far from zero, so raw squares would not do
    x = np.column_stack([base, base[:, :3] * 2 + rng.normal(size=(120, 3)) * 1e-3, base[:, 1] * 0.5, np.full(120, 4.0)])
    names = [f"c{i}" for i in range(x.shape[1])]
    rows = [tuple(float(v) for v in r) for r in x]
    rows[3] = (None, *rows[3][1:])
    x[3, 0] = 0.0
    wide = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.corrcoef(x.T)
    var, gone = x.var(0), set()
    for i in range(len(names)):
        if i in gone:
            continue
        for j in range(i + 1, len(names)):
            if j not in gone and abs(corr[i, j]) > 0.95:
                gone.add(i if var[i] < var[j] else j)
    kept = {r["feature"]: r["variance"] for r in gram.select_uncorrelated(wide, names).collect()}
    assert set(kept) == {n for i, n in enumerate(names) if i not in gone} and gone
    assert np.allclose([kept[n] for n in kept], [var[names.index(n)] for n in kept])
    found = {(r["i"], r["j"]): r["r"] for r in gram.correlated_pairs(wide, names).collect()}
    assert len(found) == len(names) * (len(names) - 1) // 2
    assert all((v is None and np.isnan(corr[k])) or abs(v - corr[k]) < 1e-9 for k, v in found.items())


def _shrunk(plane):
    """The published rule on one whole plane: gradient over labels, then distance to the nearest zero over one."""
    def grad(a, axis):
        return np.gradient(a.astype(float), axis=axis)

    out = plane.copy()
    out[np.hypot(grad(plane, 0), grad(plane, 1)) > 0] = 0
    zero = np.pad(out == 0, 1)
    near = zero[1:-1, 1:-1] | zero[:-2, 1:-1] | zero[2:, 1:-1] | zero[1:-1, :-2] | zero[1:-1, 2:]
    return np.where(near, 0, out)


def test_faces_of_a_labelled_volume(spark):
    rng = np.random.default_rng(3)
    shape, block = {"z": 10, "y": 13, "x": 14}, {"z": 5, "y": 6, "x": 7}
    a = np.zeros((10, 13, 14), int)
    for label in range(1, 7):
        z, y, x = rng.integers(0, 7, 3)
        a[z : z + 6, y : y + 8, x : x + 8] = label
    rows = [(0, *map(int, p), int(a[tuple(p)])) for p in np.argwhere(a > 0)]
    px = spark.createDataFrame(rows, "image_id long, z long, y long, x long, gid long")
    got = {(r["src"], r["dst"]) for r in volume.touching_faces(px, block, shape).collect()}
    plain = {(r["src"], r["dst"]) for r in volume.touching_faces(px, block, shape, shrink=False).collect()}
    want, raw = set(), set()
    for k, (axis, size) in enumerate(block.items()):
        u, v = (c for c in "zyx" if c != axis)
        for at in range(size, shape[axis], size):
            low, high = np.take(a, at - 1, k), np.take(a, at, k)
            raw |= {(int(p), int(q)) for p, q in zip(low.ravel(), high.ravel(), strict=True) if p and q}
            for i in range(0, shape[u], block[u]):
                for j in range(0, shape[v], block[v]):
                    cut = np.s_[i : i + block[u], j : j + block[v]]
                    if min(low[cut].shape) > 1:
                        pairs = zip(_shrunk(low[cut]).ravel(), _shrunk(high[cut]).ravel(), strict=True)
                        want |= {(int(p), int(q)) for p, q in pairs if p and q}
                    else:
                        pairs = None
    assert plain == raw
    thin = {(p, q) for p, q in got - want}  # faces one pixel wide have no gradient of their own in the published rule
    assert want <= got and len(thin) <= len(raw)


def test_faces_move_each_pixel_once(spark):
    """Small blocks, several pieces and images, two dimensions; no joins and no copies to neighbours."""
    rng = np.random.default_rng(4)
    block, shape, met = {"y": 4, "x": 200}, {"y": 13, "x": 640}, set()
    a = np.repeat(rng.integers(0, 3, (2, 13, 64)), 10, axis=2)
    rows = [(int(i), int(y), int(x), int(a[i, y, x] + 10 * (y // 4) + 100 * (x // 200))) for i, y, x in zip(*np.nonzero(a))]
    px = spark.createDataFrame(rows, "image_id long, y long, x long, gid long").repartition(3)
    gid = {r[:3]: r[3] for r in rows}

    def kept(i, y, x, axis):
        """The id of a face pixel that stays; along a face of one axis."""
        c, n, top = (x, 200, 640) if axis == "y" else (y, 4, 13)
        at = lambda q: gid.get((i, y, q) if axis == "y" else (i, q, x), 0)
        ok = lambda q: 0 <= q < top and q // n == c // n
        flat = lambda q: at(q) and (at(q - 1) if ok(q) and 0 <= q - 1 and (q - 1) // n == q // n else at(q)) == (at(q + 1) if q + 1 < top and (q + 1) // n == q // n else at(q))
        return at(c) if flat(c) and all(flat(q) for q in (c - 1, c + 1) if ok(q)) else 0

    for i, y, x in gid:
        for axis, n, to in (("y", 4, (i, y + 1, x)), ("x", 200, (i, y, x + 1))):
            if ((y if axis == "y" else x) + 1) % n == 0 and to in gid and kept(i, y, x, axis) and kept(*to, axis):
                met.add((gid[i, y, x], gid[to]))
    found = volume.touching_faces(px, block, shape)
    assert {(r["src"], r["dst"]) for r in found.collect()} == met and len(met) > 5
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(") == 2  # the pixels and the pairs
