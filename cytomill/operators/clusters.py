"""Clustering quality from contingency tables, and the learning steps built on pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomill.operators.matching import assign_max
from cytomill.operators.ordered import attach, join_on, top_k


def contingency(df: DataFrame, keys: Sequence[str], cluster: str, klass: str, skip: Sequence[str] = ("unknown",)) -> DataFrame:
    """(keys, cluster, class, n) without noise (-1) and unknown labels."""
    ok = (F.col(cluster) != -1) & ~F.col(klass).cast("string").isin(*skip)
    return df.where(ok).groupBy(*keys, F.col(cluster).alias("cluster"), F.col(klass).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def agreement_scores(c: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NMI (arithmetic mean), adjusted Rand index and purity; groups below 3 rows give no result."""
    nn = F.col("n").cast("double")
    tot = c.groupBy(*keys).agg(F.sum("n").cast("double").alias("t"))
    a = c.groupBy(*keys, "cluster").agg(F.sum(nn).alias("a"), F.max(nn).alias("top"))
    b = c.groupBy(*keys, "class").agg(F.sum(nn).alias("b"))
    pair = lambda x: x * (x - 1) / 2
    sa = a.groupBy(*keys).agg(F.sum(pair(F.col("a"))).alias("pa"), F.sum(F.col("a") * F.log("a")).alias("la"), F.sum("top").alias("top"))
    sb = b.groupBy(*keys).agg(F.sum(pair(F.col("b"))).alias("pb"), F.sum(F.col("b") * F.log("b")).alias("lb"))
    sc = c.groupBy(*keys).agg(F.sum(pair(nn)).alias("pc"), F.sum(nn * F.log(nn)).alias("lc"))
    j = join_on(join_on(join_on(tot, sa, keys), sb, keys), sc, keys) if keys else tot.transform(attach, sa).transform(attach, sb).transform(attach, sc)
    j = j.where("t >= 3")
    t = F.col("t")
    ha, hb, hab = F.log(t) - F.col("la") / t, F.log(t) - F.col("lb") / t, F.log(t) - F.col("lc") / t
    nmi = F.when((F.abs(ha) < 1e-12) & (F.abs(hb) < 1e-12), F.lit(1.0)).otherwise((ha + hb - hab) / F.nullif((ha + hb) / 2, F.lit(0.0)))
    expect = F.col("pa") * F.col("pb") / pair(t)
    ari = F.coalesce((F.col("pc") - expect) / F.nullif((F.col("pa") + F.col("pb")) / 2 - expect, F.lit(0.0)), F.lit(1.0))
    return j.select(*keys, t.cast("long").alias("n"), nmi.alias("nmi"), ari.alias("ari"), (F.col("top") / t).alias("purity"))


def matched_accuracy(c: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of rows on the best one-to-one cluster-to-class mapping; Python sees a k x k table per key."""
    work = c if keys else c.withColumn("__k", F.lit(0))
    by = list(keys) or ["__k"]
    schema = ", ".join(f"{k} {work.schema[k].dataType.simpleString()}" for k in by) + ", accuracy double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="cluster", columns="class", values="n", aggfunc="sum", fill_value=0).to_numpy(dtype=float)
        hit = sum(m[i, j] for i, j in assign_max(m))
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in by], hit / m.sum()]], columns=[*by, "accuracy"])

    out = work.groupBy(*by).applyInPandas(solve, schema)
    return out if keys else out.drop("__k")


def bootstrap_counts(df: DataFrame, cluster: str, klass: str, replicates: int, seed: int = 42) -> DataFrame:
    """Contingency of stratified resamples: per class, draws of exactly its size, with replacement.

    A resample of a class is a multinomial over its clusters, so it is drawn from the contingency
    counts: the work is replicates x cells of the table, whatever the number of rows.
    """
    c = contingency(df, [], cluster, klass)
    schema = f"replicate long, cluster {c.schema['cluster'].dataType.simpleString()}, class {c.schema['class'].dataType.simpleString()}, n long"
    reps = c.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        n = pdf["n"].to_numpy()
        key = f"{seed}/{pdf['replicate'].iloc[0]}/{pdf['class'].iloc[0]}"
        rng = np.random.default_rng(list(key.encode()))
        return pdf.assign(n=rng.multinomial(int(n.sum()), n / n.sum()))[["replicate", "cluster", "class", "n"]]

    return reps.groupBy("replicate", "class").applyInPandas(draw, schema).where("n > 0")


def normal_interval(values: DataFrame, value: str, estimate: DataFrame) -> DataFrame:
    """Point estimate (the one row of `estimate`), sample std over replicates and estimate +- 1.96 std clipped to [0, 1]."""
    s = values.agg(F.stddev_samp(value).alias("std")).transform(attach, estimate.select(F.col(value).alias("estimate")))
    half = 1.96 * F.col("std")
    return s.select("estimate", "std", F.greatest(F.col("estimate") - half, F.lit(0.0)).alias("low"), F.least(F.col("estimate") + half, F.lit(1.0)).alias("high"))


def majority_cluster(df: DataFrame, by: Sequence[str], cluster: str) -> DataFrame:
    """Most frequent cluster per treatment (smallest id on ties), number of fields and of agreeing fields."""
    c = df.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*by).agg(
        F.max_by(cluster, F.struct(F.col("n"), -F.col(cluster))).alias(cluster), F.sum("n").alias("n_fields"), F.max("n").alias("n_agree")
    )


def mean_vectors(df: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean of an array column (long: by, i, value); sums per position, map-side combined."""
    e = df.select(*by, F.posexplode(vector).alias("i", "v"))
    return e.groupBy(*by, "i").agg(F.avg("v").alias("value"))


def pca(df: DataFrame, vector: str, k: int) -> tuple[DataFrame, list[float]]:
    """Centred principal components (array column `pc`) and explained variance shares."""
    size = len(df.select(vector).first()[0])
    mean = df.agg(*[F.avg(F.coalesce(F.col(vector)[i].cast("double"), F.lit(0.0))).alias(f"m{i}") for i in range(size)])
    j = df.transform(attach, mean.select(F.array(*[f"m{i}" for i in range(size)]).alias("__m")))
    cent = F.zip_with(F.transform(vector, lambda v: F.coalesce(v.cast("double"), F.lit(0.0))), "__m", lambda a, b: a - b)
    j = j.withColumn("__v", array_to_vector(cent)).drop("__m")
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(j)
    out = model.transform(j).withColumn("pc", vector_to_array("__p")).drop("__v", "__p")
    return out, [float(v) for v in model.explainedVariance]


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """Adds `cluster`; of fewer distinct vectors than `k` each is a cluster of its own."""
    k = min(k, df.select(vector).distinct().limit(k).count())
    if k < 2:
        return df.withColumn("cluster", F.lit(0).cast("long"))
    j = df.withColumn("__v", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(j).transform(j).drop("__v").withColumn("cluster", F.col("cluster").cast("long"))


def kmeans_columns(df: DataFrame, columns: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    j = VectorAssembler(inputCols=list(columns), outputCol="__v", handleInvalid="keep").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(j).transform(j).drop("__v").withColumn("cluster", F.col("cluster").cast("long"))


def _standard(values: DataFrame, unit: Sequence[str], feature: str, value: str) -> DataFrame:
    """Row-standardised values: z_i with sum 0 and sum of squares F, so r = sum z_i z_j / F."""
    s = values.groupBy(*unit).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"), F.count(F.lit(1)).alias("__f"))
    j = join_on(values, s, unit)
    return j.where(F.col("__s") > 0).select(*unit, feature, ((F.col(value) - F.col("__m")) / F.nullif("__s", F.lit(0.0)) / F.sqrt("__f")).alias("z"))


def class_consistency(values: DataFrame, unit: str, klass: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Mean and spread of profile correlations within and between classes, without listing the pairs.

    With unit-length profiles z, the sum of r over pairs is (|sum z|^2 - n) / 2 and the sum of r^2 is
    (|sum z z'|_F^2 - n) / 2; both come from per-class sums over features and feature pairs.
    """
    z = _standard(values.select(unit, klass, feature, value), [unit, klass], feature, value)
    n = z.select(unit, klass).distinct().groupBy(klass).agg(F.count(F.lit(1)).cast("double").alias("n"))
    s = z.groupBy(klass, feature).agg(F.sum("z").alias("s"))
    s1 = s.groupBy(klass).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    left, right = z.withColumnsRenamed({feature: "f", "z": "zf"}), z.select(unit, klass, F.col(feature).alias("g"), F.col("z").alias("zg"))
    gram = left.join(right, [unit, klass]).groupBy(klass, "f", "g").agg(F.sum(F.col("zf") * F.col("zg")).alias("m"))
    s2 = gram.groupBy(klass).agg(F.sum(F.col("m") * F.col("m")).alias("q2"))
    per = n.join(s1, klass).join(s2, klass).where("n >= 1")
    per = per.select(klass, "n", (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), ((F.col("q") - F.col("n")) / 2).alias("r1"), ((F.col("q2") - F.col("n")) / 2).alias("r2"))
    intra = per.agg(F.sum("pairs").alias("ip"), F.sum("r1").alias("i1"), F.sum("r2").alias("i2"), F.sum("n").alias("n"))
    all1 = s.groupBy(feature).agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    all2 = gram.groupBy("f", "g").agg(F.sum("m").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("q2"))
    j = intra.transform(attach, all1).transform(attach, all2)
    tp, t1, t2 = F.col("n") * (F.col("n") - 1) / 2, (F.col("q") - F.col("n")) / 2, (F.col("q2") - F.col("n")) / 2
    ep, e1, e2 = tp - F.col("ip"), t1 - F.col("i1"), t2 - F.col("i2")
    im, em = F.col("i1") / F.nullif("ip", F.lit(0.0)), e1 / F.nullif(ep, F.lit(0.0))
    iv, ev = F.greatest(F.col("i2") / F.nullif("ip", F.lit(0.0)) - im * im, F.lit(0.0)), F.greatest(e2 / F.nullif(ep, F.lit(0.0)) - em * em, F.lit(0.0))
    pooled = F.sqrt((iv + ev) / 2)
    return j.select(
        F.col("n").cast("long").alias("n_treatments"), F.col("ip").cast("long").alias("n_intra"), ep.cast("long").alias("n_inter"), im.alias("intra_mean"), F.sqrt(iv).alias("intra_std"),
        em.alias("inter_mean"), F.sqrt(ev).alias("inter_std"), (im - em).alias("separation"), F.coalesce((im - em) / F.when(pooled > 0, pooled), F.lit(0.0)).alias("effect_size"),
    )


def class_cohesion(values: DataFrame, unit: str, klass: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Mean profile correlation inside each class with at least one pair."""
    z = _standard(values.select(unit, klass, feature, value), [unit, klass], feature, value)
    n = z.select(unit, klass).distinct().groupBy(klass).agg(F.count(F.lit(1)).cast("double").alias("n"))
    q = z.groupBy(klass, feature).agg(F.sum("z").alias("s")).groupBy(klass).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return n.join(q, klass).where("n > 1").select(klass, pairs.cast("long").alias("n_pairs"), (((F.col("q") - F.col("n")) / 2) / pairs).alias("mean_correlation"))


def gram_drift(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """RMSE between the within-group cosine matrices of two embeddings of the same rows.

    |AA' - BB'|_F^2 = |A'A|^2 + |B'B|^2 - 2 |A'B|^2, so each task folds its rows into d x d sums and
    only those are shuffled; no row pair is formed.
    """
    keys = list(by)
    cols = df.select(*keys, a, b)
    kt = ", ".join(f"{k} {cols.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kt}, kind string, i int, j int, v double, n long"

    def fold(batches):
        for pdf in batches:
            for key, g in pdf.groupby(keys, sort=False, dropna=False):
                x, y = np.stack(g[a].to_numpy()).astype(float), np.stack(g[b].to_numpy()).astype(float)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
                for kind, m in (("aa", x.T @ x), ("bb", y.T @ y), ("ab", x.T @ y)):
                    i, j = np.indices(m.shape)
                    out = pd.DataFrame({"kind": kind, "i": i.ravel(), "j": j.ravel(), "v": m.ravel(), "n": len(g)})
                    for k, v in zip(keys, key if isinstance(key, tuple) else (key,)):
                        out[k] = v
                    yield out[[*keys, "kind", "i", "j", "v", "n"]]

    part = cols.mapInPandas(fold, schema).groupBy(*keys, "kind", "i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    sq = part.groupBy(*keys).agg(
        F.sum(F.when(F.col("kind") == "ab", -2 * F.col("v") * F.col("v")).otherwise(F.col("v") * F.col("v"))).alias("d"), F.max("n").cast("double").alias("n")
    )
    return sq.select(*keys, F.col("n").cast("long").alias("n"), (F.sqrt(F.greatest("d", F.lit(0.0))) / F.col("n")).alias("rmse"))


def silhouette_squared(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """Mean silhouette with squared Euclidean distance, from per-cluster sums (no pairs).

    The mean squared distance of x to cluster C is |x|^2 - 2 x.mean(C) + mean |y|^2 over C.
    """
    d = df.withColumn("__id", F.monotonically_increasing_id()) if "__id" not in df.columns else df
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, e: acc + e.cast("double") * e.cast("double"))
    d = d.select(F.col(cluster).alias("c"), vector, norm(F.col(vector)).alias("q"))
    stats = d.groupBy("c").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("q").alias("mq"))
    means = mean_vectors(d, ["c"], vector).groupBy("c").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "value"))), lambda s: s.value).alias("m"))
    table = stats.join(means, "c").agg(F.collect_list(F.struct("c", "n", "mq", "m")).alias("t"))  # one row per cluster
    j = d.transform(attach, table)
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, e: acc + e)
    dist = F.transform("t", lambda s: F.struct(s.c.alias("c"), s.n.alias("n"), (F.col("q") - 2 * dot(F.col(vector), s.m) + s.mq).alias("d")))
    j = j.select("c", dist.alias("d"))
    own = F.filter("d", lambda s: s.c == F.col("c"))[0]
    other = F.array_min(F.transform(F.filter("d", lambda s: s.c != F.col("c")), lambda s: s.d))
    a = own.d * own.n / F.nullif(own.n - 1, F.lit(0.0))
    s = F.when(own.n == 1, F.lit(0.0)).otherwise((other - a) / F.nullif(F.greatest(a, other), F.lit(0.0)))
    return j.agg(F.avg(F.coalesce(s, F.lit(0.0))).alias("silhouette"))


def phenotype_scores(pairs: DataFrame, level: str, truth: str, pred: str) -> DataFrame:
    """Accuracy and macro F1 per level from one row per matched cell."""
    c = pairs.groupBy(level, truth, pred).agg(F.count(F.lit(1)).alias("n"))
    per_t = c.groupBy(level, F.col(truth).alias("k")).agg(F.sum("n").alias("nt"), F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    per_p = c.groupBy(level, F.col(pred).alias("k")).agg(F.sum("n").alias("np"))
    j = per_t.join(per_p, [level, "k"], "left").fillna(0, ["np"]).withColumn("f1", 2 * F.col("tp") / (F.col("nt") + F.col("np")))
    return j.groupBy(level).agg(
        F.sum("nt").alias("n_valid"), F.sum("tp").alias("n_correct"), (F.sum("tp") / F.sum("nt")).alias("accuracy"), F.avg("f1").alias("macro_f1")
    )


def knn_labels(labelled: DataFrame, rest: DataFrame, k: int, id: str = "id", x: str = "x", y: str = "y", label: str = "label") -> DataFrame:
    """k-nearest vote for unlabelled points in the plane; equal votes go to the smaller label."""
    from cytomill.operators.spatial import nearest

    near = nearest(rest, labelled, k, (), x, y, id).join(labelled.select(F.col(id).alias("dst"), label), "dst")
    votes = near.groupBy("src", label).agg(F.count(F.lit(1)).alias("v"))
    return votes.groupBy("src").agg(F.max_by(label, F.struct(F.col("v"), -F.col(label))).alias(label)).withColumnRenamed("src", id)


def top_per_class(df: DataFrame, klass: str, score: str, name: str, k: int) -> DataFrame:
    return top_k(df, [klass], [F.desc(F.abs(score)), F.col(name)], k)
