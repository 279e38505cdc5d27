import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytomill.operators import inference as inf
from cytomill.operators import ordered as od


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one key is NULL, values have ties, signs and a far outlier."""
    rng = np.random.default_rng(3)
    g = np.where(rng.random(4000) < 0.7, "hot", np.where(rng.random(4000) < 0.5, "cold", None))
    v = np.round(rng.normal(0, 10, 4000), 1)
    v[0] = 1e12
    pdf = pd.DataFrame({"g": g, "v": v, "id": np.arange(4000)})
    return pdf, spark.createDataFrame(pdf, "g string, v double, id long").cache()


def _by_group(pdf):
    return {None if pd.isna(k) else k: d for k, d in pdf.groupby("g", dropna=False)}


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    got = {r["g"]: r for r in od.quantiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5, "q9": 0.9}).collect()}
    for k, d in _by_group(pdf).items():
        for name, p in (("q1", 0.25), ("m", 0.5), ("q9", 0.9)):
            assert got[k][name] == pytest.approx(np.percentile(d["v"], p * 100), rel=1e-12, abs=1e-12)


def test_median_mad(skewed):
    pdf, df = skewed
    got = {r["g"]: r for r in od.median_mad_columns(df, ["g"], ["v"], count="n").collect()}
    for k, d in _by_group(pdf).items():
        m = np.median(d["v"])
        assert (got[k]["median"], got[k]["n"]) == (pytest.approx(m), len(d))
        assert got[k]["mad"] == pytest.approx(np.median(np.abs(d["v"] - m)))


def test_global_quantile_without_keys(skewed):
    pdf, df = skewed
    assert od.quantiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(np.median(pdf["v"]))


def test_values_that_are_not_finite(spark):
    v = [1.0, float("inf"), float("-inf"), float("nan"), 3.0, None, 1.0]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    assert od.quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 1.0
    ranks = {str(r["v"]): r["rank"] for r in od.average_ranks(df, [], "v").collect()}
    assert ranks == {"-inf": 1.0, "1.0": 2.5, "3.0": 4.0, "inf": 5.0, "nan": 6.0}


def test_bucket_is_monotone(spark):
    v = sorted([-1e300, -8.0, -7.999999, -1.0, -1e-300, 0.0, 1e-300, 0.5, 1.0, 1.9999999999999998, 2.0, 4.0, 1023.9999999, 1024.0, 1e300])
    b = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v double").select(od.value_bucket(F.col("v"), 6)).collect()]
    assert b == sorted(b)


def test_ranks_and_ordinals(skewed):
    pdf, df = skewed
    got = df.transform(lambda d: od.with_average_rank(d, ["g"], "v", "rk")).toPandas().sort_values("id")
    want = pdf.groupby("g", dropna=False)["v"].rank()
    assert np.allclose(got["rk"].to_numpy(), want.to_numpy())
    o = od.ordinal(df, ["g"], "v", "k", ["id"]).toPandas().sort_values("id")
    want = pdf.sort_values(["v", "id"]).groupby("g", dropna=False).cumcount() + 1
    assert (o["k"].to_numpy() == want.sort_index().to_numpy()).all()


def test_otsu_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = np.round(np.concatenate([rng.normal(0, 1, 60), rng.normal(6, 1, 25)]), 1)
    u = np.unique(v)
    cuts = (u[1:] + u[:-1]) / 2
    sse = [((v[v < c] - v[v < c].mean()) ** 2).sum() + ((v[v >= c] - v[v >= c].mean()) ** 2).sum() for c in cuts]
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("one", 3.0)] * 4 + [("two", 1.0), ("two", 2.0)], "g string, v double")
    got = {r["g"]: r["threshold"] for r in inf.otsu(df, ["g"], "v").collect()}
    assert got == {"a": pytest.approx(cuts[int(np.argmin(sse))]), "two": 1.5}


def test_bh_plain_and_monotone(spark):
    p = [("a", 0.01), ("b", 0.01), ("c", 0.03), ("d", 0.029), ("e", 0.9)]
    df = spark.createDataFrame(p, "t string, p double")
    plain = {r["t"]: r["p_adj"] for r in inf.bh_adjust(df, [], "p", "t").collect()}
    assert plain == {"a": 0.05, "b": pytest.approx(0.025), "d": pytest.approx(0.029 * 5 / 3), "c": pytest.approx(0.0375), "e": pytest.approx(0.9)}
    mono = {r["t"]: r["p_adj"] for r in inf.bh_adjust(df, [], "p", "t", monotone=True).collect()}
    assert mono["a"] == pytest.approx(0.025) and mono["d"] == pytest.approx(0.0375)
