"""Result tables: counting errors, score summaries, rankings, best-of selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytomill.operators.ordered import attach, join_on, pearson, quantiles


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, population std, median, min, max, total."""
    s = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("total"),
    )
    return join_on(s, quantiles(df, keys, value, {"median": 0.5}), keys)


def counting_errors(df: DataFrame, keys: Sequence[str], truth: str = "gt", pred: str = "pred") -> DataFrame:
    """MAE, RMSE, R2 (0 without variance), r (0 below three rows or without spread), mean % error where truth is not 0,
    standard deviation of the error and its 95 % half-width."""
    g, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    e = p - g
    s = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_images"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(g).alias("vg"),
        pearson(g, p).alias("corr"), F.avg(F.when(g != 0, e / F.nullif(g, F.lit(0.0)) * 100)).alias("mpe"), F.stddev_samp(e).alias("sd"),
    )
    n = F.col("n_images")
    return s.select(
        *keys, "n_images", "mae", F.sqrt("mse").alias("rmse"),
        F.when(F.col("vg") * n <= 1e-12, F.lit(0.0)).otherwise(1 - F.col("mse") / F.nullif("vg", F.lit(0.0))).alias("r2"),
        F.when(n < 3, F.lit(0.0)).otherwise(F.coalesce("corr", F.lit(0.0))).alias("r"),
        F.coalesce("mpe", F.lit(0.0)).alias("mpe"), F.coalesce("sd", F.lit(0.0)).alias("error_std"),
        F.coalesce(1.96 * F.col("sd") / F.sqrt(n), F.lit(0.0)).alias("ci95"),
    )


def weighted_overall(metrics: DataFrame, keys: Sequence[str], columns: Sequence[str], weight: str = "n_images") -> DataFrame:
    """Metrics averaged over datasets with the number of images as weight."""
    w = F.col(weight)
    return metrics.groupBy(*keys).agg(F.sum(w).alias(weight), *[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in columns])


def best_rows(metrics: DataFrame, keys: Sequence[str], name: str, lower: Sequence[str], higher: Sequence[str]) -> DataFrame:
    """Name of the best row per metric (first name on ties)."""
    best = [F.min_by(name, F.struct(F.col(c), F.col(name))).alias(f"best_{c}") for c in lower]
    best += [F.min_by(name, F.struct(-F.col(c), F.col(name))).alias(f"best_{c}") for c in higher]
    return metrics.groupBy(*keys).agg(*best)


def long_metrics(metrics: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return metrics.select(*ids, *[F.col(c).cast("double") for c in columns]).unpivot(list(ids), list(columns), "metric", "value")


def metric_sheet(long: DataFrame, rows: Sequence[str], across: str, names: Sequence[str]) -> DataFrame:
    """Metric table with one column per model; the column names are given, so there is no extra scan."""
    return long.groupBy(*rows).pivot(across, list(names)).agg(F.first("value"))


def corpus_rollup(manifest: DataFrame, levels: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Totals for each level prefix, with 'all' standing for the rolled-up levels."""
    agg = manifest.rollup(*levels).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(c) for c in sums])
    return agg.fillna("all", list(levels))


def grid_best(scores: DataFrame, params: Sequence[str], score: str) -> DataFrame:
    """Parameter tuple with the best mean score; the first tuple in order wins a tie."""
    m = scores.groupBy(*params).agg(F.round(F.avg(score), 9).alias("mean_score"))
    return m.orderBy(F.desc("mean_score"), *params).limit(1)


def method_means(scores: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(score).alias("mean_score"), F.count(score).alias("n"))


def relative_gain(scores: DataFrame, dataset: str, method: str, score: str, methods: Sequence[str], baseline: str) -> DataFrame:
    """Mean % gain over the baseline per method; data sets with a missing score or a 0 baseline are left out."""
    wide = scores.groupBy(dataset).pivot(method, list(methods)).agg(F.avg(score)).na.drop().where(F.col(baseline) != 0)
    gains = [F.avg((F.col(m) - F.col(baseline)) / F.nullif(F.col(baseline), F.lit(0.0)) * 100).alias(m) for m in methods if m != baseline]
    one = wide.agg(F.count(F.lit(1)).alias("n_datasets"), *gains)
    rest = [m for m in methods if m != baseline]
    return one.unpivot(["n_datasets"], rest, "method", "gain")


def average_ranks_by_method(scores: DataFrame, dataset: str, method: str, score: str) -> DataFrame:
    """Ordinal rank of the methods per data set, mean rank, final rank. Groups are one data set's methods."""
    w = W.partitionBy(dataset).orderBy(F.desc(score), method)
    per = scores.where(F.col(score).isNotNull()).withColumn("__r", F.row_number().over(w))
    mean = per.groupBy(method).agg(F.avg("__r").alias("mean_rank"), F.count(F.lit(1)).alias("n_datasets"))
    final = W.partitionBy(F.lit(0)).orderBy("mean_rank", method)  # one row per method
    return mean.withColumn("final_rank", F.row_number().over(final).cast("long"))


def win_matrix(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Wins, losses and ties of method a against b over data sets; needs a, b, p, total_diff."""
    sig = F.col("p") < alpha
    return tests.groupBy("a", "b").agg(
        F.sum((sig & (F.col("total_diff") > 0)).cast("long")).alias("wins"),
        F.sum((sig & (F.col("total_diff") < 0)).cast("long")).alias("losses"),
        F.sum((~sig | (F.col("total_diff") == 0)).cast("long")).alias("ties"),
    )


def ratio_of_sums(df: DataFrame, keys: Sequence[str], top: str, bottom: str) -> DataFrame:
    """Sum over sum, e.g. annotation time per object; rows with a missing time are dropped."""
    return df.where(F.col(top).isNotNull()).groupBy(*keys).agg((F.sum(top) / F.nullif(F.sum(bottom), F.lit(0))).alias("ratio"))


def first_last(df: DataFrame, keys: Sequence[str], order: str, score: str) -> DataFrame:
    """Score of the first and the last iteration."""
    return df.groupBy(*keys).agg(F.min_by(score, order).alias("first_score"), F.max_by(score, order).alias("last_score"), F.count(F.lit(1)).alias("n"))


def equal_width_histogram(df: DataFrame, keys: Sequence[str], value: Column, edges: tuple[float, float], bins: int) -> DataFrame:
    """Share of rows per bin of [lo, hi); values outside fall into the first or last bin."""
    lo, hi = edges
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value - lo) / ((hi - lo) / bins))))
    c = df.groupBy(*keys, b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy(*keys).agg(F.sum("n").alias("total"))
    return join_on(c, total, keys).select(*keys, "bin", (F.col("n") / F.col("total")).alias("share"))


def binned_performance(df: DataFrame, feature: str, score: str, edges: DataFrame) -> DataFrame:
    """Mean score and share of misses (score 0) per tercile of a feature; `edges` has one row e1, e2."""
    j = df.transform(attach, edges)
    b = F.when(F.col(feature) <= F.col("e1"), 0).when(F.col(feature) <= F.col("e2"), 1).otherwise(2)
    return j.groupBy(b.cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg((F.col(score) == 0).cast("double")).alias("miss_rate")
    )


def line_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation, slope and intercept; NULL when x has no spread."""
    s = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), pearson(x, y).alias("r"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("v"), F.avg(x).alias("mx"), F.avg(y).alias("my")
    )
    slope = F.col("c") / F.nullif("v", F.lit(0.0))
    return s.select(*keys, "n", "r", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))
