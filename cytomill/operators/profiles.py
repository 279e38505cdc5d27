"""Per-field medians, per-plate control normalisation, feature selection, treatment profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomill.functions.scalar import finite
from cytomill.operators.ordered import attach, join_on, median_mad, median_mad_columns, pearson


def feature_columns(df: DataFrame, metadata: Sequence[str]) -> list[str]:
    """Numeric columns that are not metadata, in table order."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [c for c, t in df.dtypes if t in numeric and c not in set(metadata)]


def to_long(wide: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(ids, feature, value); NaN and the infinities become NULL here, once."""
    cast = wide.select(*ids, *[finite(F.col(c)).alias(c) for c in features])
    return cast.unpivot(list(ids), list(features), "feature", "value")


def field_profiles(cells: DataFrame, group: Sequence[str], features: Sequence[str], min_cells: int = 5) -> DataFrame:
    """Long (group, n_cells, feature, median, mad); groups below `min_cells` are left out."""
    clean = cells.select(*group, *[finite(F.col(c)).alias(c) for c in features])
    return median_mad_columns(clean, group, features, count="n_cells").where(F.col("n_cells") >= min_cells)


def profile_values(profiles: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Median and MAD as two features per source feature: (keep, feature, value)."""
    return profiles.select(
        *keep,
        F.inline(
            F.array(
                F.struct(F.concat("feature", F.lit("_median")).alias("feature"), F.col("median").alias("value")),
                F.struct(F.concat("feature", F.lit("_mad")).alias("feature"), F.col("mad").alias("value")),
            )
        ),
    )


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one with the greatest `order`."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__s"))
    return one.select(*keys, "__s.*")


def join_treatments(profiles: DataFrame, table: DataFrame, keys: Sequence[str], order: str, defaults: dict[str, Column]) -> DataFrame:
    """Lookup join: the last table row wins per key, and defaults fill what is missing."""
    cols = list(defaults)
    one = last_wins(table.select(*keys, order, *cols), keys, order).drop(order)
    j = join_on(profiles, one, keys, "left", null_safe=True)
    return j.select(*[c for c in j.columns if c not in cols], *[F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()])


def unified_fields(fields: DataFrame, meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of fields to one metadata row per key, with control flag and labels filled in.

    Expects compound, moa, concentration in `meta`; duplicate metadata keys fail the job.
    """
    n = meta.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in ("compound", "moa", "concentration")])
    n = n.withColumn("__ok", F.assert_true(F.col("__n") == 1, F.lit("duplicate metadata key")))
    j = join_on(fields, n, keys, "left", null_safe=True)
    control = F.col("compound").isNull() | F.lower("compound").isin("", "dmso")
    return (
        j.where(F.col("__ok").isNull()).drop("__n", "__ok")
        .withColumn("is_control", control)
        .withColumn("compound", F.when(control, F.lit("DMSO")).otherwise(F.col("compound")))
        .withColumn("moa", F.when(control, F.lit("DMSO")).otherwise(F.coalesce(F.nullif("moa", F.lit("")), F.lit("unknown"))))
        .withColumn("concentration", F.when(control, F.lit(0.0)).otherwise(F.col("concentration").cast("double")))
    )


def robust_z(values: DataFrame, plate: str, control: str, unit: Sequence[str], min_controls: int = 5) -> DataFrame:
    """Adds z = (value - median) / MAD of the reference fields.

    Reference per plate: its own controls when there are at least `min_controls`, else the controls
    of all plates under the same rule, else every field. All three references are summarised in one
    pass by copying a row into each set it belongs to.
    """
    sets = F.array_compact(
        F.array(
            F.when(F.col(control), F.struct(F.lit("plate").alias("kind"), F.col(plate).cast("string").alias("ref"))),
            F.when(F.col(control), F.struct(F.lit("controls").alias("kind"), F.lit("").alias("ref"))),
            F.struct(F.lit("all").alias("kind"), F.lit("").alias("ref")),
        )
    )
    spread = values.select("feature", "value", F.inline(sets))
    keys = ["kind", "ref", "feature"]
    mm = median_mad(spread.withColumnRenamed("feature", "__f"), ["kind", "ref", "__f"], "value").withColumnRenamed("__f", "feature")
    sd = spread.groupBy(*keys).agg(F.stddev_pop("value").alias("sd"))
    scale = F.when(F.col("mad") < 1e-10, F.col("sd") + 1e-10).otherwise(F.col("mad"))
    ref = join_on(mm, sd, keys, null_safe=True).select(*keys, "median", scale.alias("scale"))
    units = values.select(plate, control, *unit).distinct()
    n_plate = units.where(F.col(control)).groupBy(plate).agg(F.count(F.lit(1)).alias("n"))
    n_all = units.agg(F.count(F.when(F.col(control), 1)).alias("n_controls"))
    plates = join_on(units.select(plate).distinct(), n_plate, [plate], "left", null_safe=True).transform(attach, n_all)
    kind = F.when(F.col("n") >= min_controls, F.lit("plate")).when(F.col("n_controls") >= min_controls, F.lit("controls")).otherwise(F.lit("all"))
    plates = plates.select(plate, kind.alias("kind")).withColumn("ref", F.when(F.col("kind") == "plate", F.col(plate).cast("string")).otherwise(F.lit("")))
    per = plates.join(ref, ["kind", "ref"]).select(plate, "feature", "median", "scale")
    return join_on(values, per, [plate, "feature"], "left", null_safe=True).withColumn("z", (F.col("value") - F.col("median")) / F.col("scale")).drop("median", "scale")


def stable_features(values: DataFrame, value: str = "value", max_missing: float = 0.5, min_variance: float = 0.01) -> DataFrame:
    """(feature, missing, variance) of features that pass the missing-value and variance rules."""
    s = values.groupBy("feature").agg(
        F.avg(F.col(value).isNull().cast("double")).alias("missing"), F.var_pop(F.coalesce(F.col(value), F.lit(0.0))).alias("variance")
    )
    return s.where((F.col("missing") < max_missing) & (F.col("variance") > min_variance))


def feature_correlations(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, r) for a before b, in one aggregation over all rows; NULL counts as 0."""
    cols = [F.coalesce(F.col(c), F.lit(0.0)) for c in features]
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]
    one = wide.agg(*[pearson(cols[i], cols[j]).alias(f"r{i}_{j}") for i, j in pairs])
    rows = [F.struct(F.lit(features[i]).alias("a"), F.lit(features[j]).alias("b"), F.col(f"r{i}_{j}").alias("r")) for i, j in pairs]
    return one.select(F.inline(F.array(*rows)))


def treatment_profiles(values: DataFrame, by: Sequence[str], unit: Sequence[str], value: str = "z") -> DataFrame:
    """Mean of finite values per treatment and feature with the number of fields behind it."""
    return values.groupBy(*by, "feature").agg(F.avg(finite(F.col(value))).alias("value"), F.countDistinct(*unit).alias("n_fields"))


def treatment_counts(fields: DataFrame, by: Sequence[str], moa: str, n_cells: str) -> DataFrame:
    return fields.groupBy(*by).agg(F.count(F.lit(1)).alias("n_fields"), F.sum(n_cells).alias("n_cells_total"), F.min(moa).alias("moa"))


def treatment_summary(images: DataFrame, by: Sequence[str], well: Sequence[str], plate: str, firsts: Sequence[str]) -> DataFrame:
    return images.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_images"), F.countDistinct(*well).alias("n_wells"), F.countDistinct(plate).alias("n_plates"),
        *[F.min(c).alias(c) for c in firsts],
    )


def class_distribution(images: DataFrame, moa: str, compound: str) -> DataFrame:
    return images.groupBy(moa).agg(F.countDistinct(compound).alias("n_compounds"), F.count(F.lit(1)).alias("n_fields"))


def class_heatmap(values: DataFrame, moa: str, unit: Sequence[str], min_units: int = 2, value: str = "z") -> DataFrame:
    """Mean per class and feature for classes with at least `min_units` members."""
    return (
        values.groupBy(moa, "feature").agg(F.avg(value).alias("value"), F.countDistinct(*unit).alias("n"))
        .where(F.col("n") >= min_units)
    )


def compound_deviation(values: DataFrame, compound: str, control: str, value: str = "z") -> DataFrame:
    """Mean profile minus the control mean per compound and feature, with the compound's mean |deviation|."""
    mean = values.groupBy(compound, "feature").agg(F.avg(value).alias("m"))
    ctrl = values.where(F.col(control)).groupBy("feature").agg(F.avg(value).alias("c"))
    dev = join_on(mean, ctrl, ["feature"], null_safe=True).select(compound, "feature", (F.col("m") - F.col("c")).alias("deviation"))
    size = dev.groupBy(compound).agg(F.avg(F.abs("deviation")).alias("mean_abs_deviation"))
    return join_on(dev, size, [compound], null_safe=True)


def expected_vs_found(expected: DataFrame, found: DataFrame, by: Sequence[str], field: Sequence[str]) -> DataFrame:
    """Audit of distinct fields per group on both sides; `complete` when nothing is missing."""
    e = expected.groupBy(*by).agg(F.countDistinct(*field).alias("n_expected"))
    f = found.groupBy(*by).agg(F.countDistinct(*field).alias("n_found"))
    j = e.join(f, list(by), "full").fillna(0, ["n_expected", "n_found"])
    return j.withColumn("complete", F.col("n_found") >= F.col("n_expected"))
