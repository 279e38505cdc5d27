"""Two-sample tests, effect sizes, multiple testing, rank statistics, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomill.functions import tails
from cytomill.operators.ordered import attach, average_ranks, join_on, ordinal, pearson, quantiles, running_sums, with_average_rank
from cytomill.session import cut


def moments(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """n, mean and M2 (sum of squared deviations) per key: everything the t tests need."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(F.lit(1))).alias("m2")
    )


def without(part: dict[str, Column], whole: dict[str, Column]) -> dict[str, Column]:
    """Moments of whole minus part, in the numerically stable form."""
    n = whole["n"] - part["n"]
    mean = (whole["n"] * whole["mean"] - part["n"] * part["mean"]) / F.nullif(n, F.lit(0))
    gap = part["mean"] - mean
    m2 = whole["m2"] - part["m2"] - gap * gap * part["n"] * n / whole["n"]
    return {"n": n, "mean": mean, "m2": F.greatest(m2, F.lit(0.0))}


def welch(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column]:
    """(t, degrees of freedom) of the unequal-variance test; NULL when a side has fewer than 2 rows."""
    va, vb = a["m2"] / F.nullif(a["n"] - 1, F.lit(0)) / a["n"], b["m2"] / F.nullif(b["n"] - 1, F.lit(0)) / b["n"]
    s = F.nullif(va + vb, F.lit(0.0))
    t = (a["mean"] - b["mean"]) / F.sqrt(s)
    return t, s * s / (va * va / (a["n"] - 1) + vb * vb / (b["n"] - 1))


def student(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column]:
    """(t, degrees of freedom) of the equal-variance test."""
    dof = a["n"] + b["n"] - 2
    s2 = F.nullif((a["m2"] + b["m2"]) / F.nullif(dof, F.lit(0)), F.lit(0.0))
    return (a["mean"] - b["mean"]) / F.sqrt(s2 * (1 / a["n"] + 1 / b["n"])), dof.cast("double")


def cohens_d(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Pooled effect size; 0 when a side has fewer than 2 rows or there is no spread."""
    pooled = F.sqrt((a["m2"] + b["m2"]) / F.nullif(a["n"] + b["n"] - 2, F.lit(0)))
    d = (a["mean"] - b["mean"]) / F.when(pooled > 0, pooled)
    return F.when((a["n"] < 2) | (b["n"] < 2), F.lit(0.0)).otherwise(F.coalesce(d, F.lit(0.0)))


def _cols(tag: str) -> dict[str, Column]:
    return {k: F.col(f"{k}{tag}") for k in ("n", "mean", "m2")}


def _tag(df: DataFrame, tag: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{k}{tag}" for k in ("n", "mean", "m2")})


def _finish(j: DataFrame, keep: Sequence[str], a: dict[str, Column], b: dict[str, Column]) -> DataFrame:
    t, dof = welch(a, b)
    out = j.select(*keep, a["n"].alias("n_a"), b["n"].alias("n_b"), (a["mean"] - b["mean"]).alias("diff"),
                   t.alias("t"), dof.alias("dof"), cohens_d(a, b).alias("cohens_d"))
    # no spread on either side: t has no finite value and counts as 0; different means are then certain (p = 0)
    flat = (F.col("n_a") >= 2) & (F.col("n_b") >= 2) & F.col("t").isNull()
    p = F.coalesce(tails.student_two_sided("t", "dof"), F.when(flat & (F.col("diff") != 0), 0.0).otherwise(1.0))
    return out.withColumn("p", p).withColumn("t", F.when(flat, 0.0).otherwise(F.col("t")))


def versus_control(values: DataFrame, group: str, control: Column, value: str = "value") -> DataFrame:
    """Each treatment group against all control rows: t, p, effect size per feature (Welch)."""
    rows = values.select(F.when(~control, F.col(group)).alias(group), "feature", value, control.alias("__c"))
    m = cut(moments(rows, [group, "feature", "__c"], value))
    c = _tag(m.where("__c").drop("__c", group), "_b")
    j = join_on(_tag(m.where("not __c").drop("__c"), "_a"), c, ["feature"])
    return _finish(j, [group, "feature"], _cols("_a"), _cols("_b"))


def class_versus_rest(values: DataFrame, group: str, value: str = "value") -> DataFrame:
    """Each class against all others; the rest is the total minus the class, so one aggregation serves all."""
    m = cut(moments(values, [group, "feature"], value))  # one row per class and feature
    total = m.groupBy("feature").agg(
        F.sum("n").alias("n_w"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean_w"), F.sum("m2").alias("within")
    )
    j = join_on(m, total, ["feature"])
    gap = F.col("mean") - F.col("mean_w")
    between = j.groupBy("feature").agg(F.sum(F.col("n") * gap * gap).alias("between"))
    j = join_on(j, between, ["feature"]).withColumn("m2_w", F.col("within") + F.col("between"))
    a = {"n": F.col("n"), "mean": F.col("mean"), "m2": F.col("m2")}
    return _finish(j, [group, "feature"], a, without(a, _cols("_w")))


def bonferroni(tests: DataFrame, keys: Sequence[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Adds `significant` = p < alpha / number of tests in the group."""
    tests = cut(tests)
    n = tests.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return join_on(tests, n, keys, null_safe=True).withColumn("significant", F.col(p) < alpha / F.col("__n")).drop("__n")


def perturbation_scores(tests: DataFrame, group: str, alpha: float = 0.05, min_n: int = 3) -> DataFrame:
    """Share of features with p < alpha / F and the largest / mean |d| per treatment."""
    t = cut(tests.where((F.col("n_a") >= min_n) & (F.col("n_b") >= min_n)))
    n = t.groupBy(group).agg(F.count(F.lit(1)).alias("n_features"))
    j = join_on(t, n, [group], null_safe=True)
    sig = F.sum((F.col("p") < alpha / F.col("n_features")).cast("long"))
    return j.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_features"), sig.alias("n_significant"), (sig / F.count(F.lit(1))).alias("score"),
        F.max(F.abs("cohens_d")).alias("max_abs_d"), F.avg(F.abs("cohens_d")).alias("mean_abs_d"),
    )


def bh_adjust(tests: DataFrame, keys: Sequence[str], p: str, tie: str, out: str = "p_adj", monotone: bool = False) -> DataFrame:
    """p * n / rank capped at 1, ties ordered by name. `monotone` adds the usual running minimum."""
    tests = cut(tests)  # one row per test, read twice by the ranking
    ranked = ordinal(tests, keys, p, "__rank", [tie])
    raw = F.least(F.col(p) * F.col("__rank_of") / F.col("__rank"), F.lit(1.0))
    ranked = ranked.withColumn(out, raw)
    if not monotone:
        return ranked.drop("__rank", "__rank_of")
    # running minimum from the largest p down, in blocks of 1024 ranks
    from pyspark.sql import Window as W

    b = ranked.withColumn("__blk", F.floor(F.col("__rank") / 1024))
    low = b.groupBy(*keys, "__blk").agg(F.min(out).alias("__m"))
    part = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(F.desc("__blk")).rowsBetween(W.unboundedPreceding, -1)
    low = low.withColumn("__later", F.min("__m").over(part)).drop("__m")
    inside = W.partitionBy(*keys, "__blk").orderBy(F.desc("__rank")).rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumn("__in", F.min(out).over(inside))
    return join_on(b, low, [*keys, "__blk"]).withColumn(out, F.least("__in", "__later")).drop("__rank", "__rank_of", "__blk", "__in", "__later")


def rank_sum(counts: DataFrame, keys: Sequence[str], value: str, a: str, b: str) -> DataFrame:
    """Mann-Whitney from a (keys, value, count in a, count in b) table: U, z, two-sided p.

    Average ranks, tie-corrected variance, continuity 0.5.
    """
    c = counts.groupBy(*keys, value).agg(F.sum(a).cast("long").alias("ca"), F.sum(b).cast("long").alias("cb"))
    c = cut(c.withColumn("c", F.col("ca") + F.col("cb")).where("c > 0"))
    r = running_sums(c, keys, value, {"__before": "c"})
    rank = F.col("__before") + (F.col("c") + 1) / 2
    cc = F.col("c").cast("double")
    s = r.groupBy(*keys).agg(
        F.sum("ca").alias("n_a"), F.sum("cb").alias("n_b"), F.sum(rank * F.col("ca")).alias("ra"), F.sum(cc * cc * cc - cc).alias("ties")
    )
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    u = F.col("ra") - na * (na + 1) / 2
    mu = na * nb / 2
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.greatest(u, na * nb - u) - mu - 0.5
    s = s.select(*keys, "n_a", "n_b", u.alias("u"), F.coalesce(z / F.nullif(sd, F.lit(0.0)), F.lit(0.0)).alias("z"))
    return s.withColumn("p", F.least(F.when(F.col("z") > 0, tails.normal_two_sided("z")).otherwise(F.lit(1.0)), F.lit(1.0)))


def signed_rank(diffs: DataFrame, keys: Sequence[str], diff: str, exact: bool = False) -> DataFrame:
    """Paired signed-rank statistics per key; zero differences are left out. `exact` asks for the exact p of untied differences."""
    d = diffs.where((F.col(diff) != 0) & F.col(diff).isNotNull()).select(*keys, F.abs(diff).alias("__a"), (F.col(diff) > 0).cast("long").alias("__pos"))
    c = cut(d.groupBy(*keys, "__a").agg(F.sum("__pos").alias("__p"), F.count(F.lit(1)).alias("__n")))
    r = running_sums(c, keys, "__a", {"__before": "__n"})
    rank = F.col("__before") + (F.col("__n") + 1) / 2
    nn = F.col("__n").cast("double")
    s = r.groupBy(*keys).agg(
        F.sum("__n").alias("n"), F.sum(rank * F.col("__p")).alias("w_plus"), F.sum(rank * (F.col("__n") - F.col("__p"))).alias("w_minus"),
        F.sum(nn * nn * nn - nn).alias("ties"),
    )
    return s.withColumn("w", F.least("w_plus", "w_minus")).withColumn("p", tails.signed_rank_p(F.col("w"), F.col("n"), F.col("ties"), exact)).drop("ties")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ties and its t-based p per key."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    d = with_average_rank(with_average_rank(d, keys, x, "__rx"), keys, y, "__ry")
    s = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("__rx", "__ry").alias("rho"))
    rho = F.coalesce(F.when(~F.isnan("rho"), F.col("rho")), F.lit(0.0))
    s = s.withColumn("rho", rho)
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(0.0)), F.lit(0.0)))
    p = F.when(F.abs("rho") >= 1.0 - 1e-12, F.lit(0.0)).otherwise(F.coalesce(tails.student_two_sided(t, (F.col("n") - 2).cast("double")), F.lit(1.0)))
    return s.withColumn("p", F.when(F.col("n") < 3, F.lit(1.0)).otherwise(p))


def dose_response(values: DataFrame, group: Sequence[str], dose: str, value: str = "value", min_doses: int = 3, alpha: float = 0.05) -> DataFrame:
    """Median per dose, then Spearman of (dose, median); monotone when |rho| > 0.7 and p < alpha."""
    med = quantiles(values, [*group, dose], value, {"median": 0.5})
    s = spearman(med, group, dose, "median").where(F.col("n") >= min_doses)
    return s.withColumnRenamed("n", "n_doses").withColumn("monotone", (F.abs("rho") > 0.7) & (F.col("p") < alpha))


def otsu(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Split between distinct values with the least within-class squared error; first one on ties.

    Works on per-value counts; groups with fewer than two distinct values give no row.
    """
    c = cut(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    v = F.col(value).cast("double")
    c = c.withColumn("s", F.col("n") * v).withColumn("q", F.col("n") * v * v)
    r = running_sums(c, keys, value, {"bn": "n", "bs": "s", "bq": "q"})
    # a split lies just below each value but the first: `before` is the lower class
    lo_n, lo_s, lo_q = F.col("bn"), F.col("bs"), F.col("bq")
    hi_n, hi_s, hi_q = F.col("bn_total") - lo_n, F.col("bs_total") - lo_s, F.col("bq_total") - lo_q
    sse = (lo_q - lo_s * lo_s / lo_n) + (hi_q - hi_s * hi_s / hi_n)
    cand = r.where("bn > 0").select(*keys, value, sse.alias("sse"))
    best = cand.groupBy(*keys).agg(F.min_by(value, F.struct(F.round("sse", 9), F.col(value))).alias("__hi"))
    # the midpoint needs the largest distinct value below the chosen one
    j = join_on(c.select(*keys, value), best, keys, null_safe=True).where(F.col(value) < F.col("__hi"))
    return j.groupBy(*keys, "__hi").agg(F.max(value).alias("__lo")).select(*keys, ((F.col("__lo") + F.col("__hi")) / 2).alias("threshold"))


def enrichment(contingency: DataFrame, cluster: str, klass: str, n: str = "n") -> DataFrame:
    """Dominant class per cluster (ties by name) with its one-sided exact p."""
    rows = contingency.groupBy(klass).agg(F.sum(n).alias("class_total"))
    best = contingency.groupBy(cluster).agg(F.sum(n).alias("cluster_total"), F.max(n).alias("__top"))
    dom = join_on(contingency, best, [cluster]).where(F.col(n) == F.col("__top")).groupBy(cluster, "cluster_total").agg(F.min(klass).alias(klass), F.max(n).alias("k"))
    total = contingency.agg(F.sum(n).alias("total"))
    j = join_on(dom, rows, [klass]).transform(attach, total)
    return j.withColumn("p", tails.fisher_upper("k", "total", "class_total", "cluster_total")).withColumn("share", F.col("k") / F.col("cluster_total"))
