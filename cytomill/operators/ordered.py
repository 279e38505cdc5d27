"""Order statistics that never put one group into one task.

A group is cut into value buckets by a fixed monotone function, bucket totals (a small table)
carry the prefix across buckets, and only the inside of one bucket is sorted together. Hot
groups therefore spread over as many tasks as they have buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import NumericType

from cytomill.functions.scalar import finite
from cytomill.session import cut

BUCKET = "__bucket"
KEY = "__key"


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def value_bucket(v: Column, bits: int) -> Column:
    """Monotone whole-number bucket of a double: exponent and the first `bits` of the mantissa.

    It depends on the value alone, so re-running a lost task gives the same buckets.
    """
    width = 1 << bits
    v = v.cast("double")
    a = F.abs(v)
    e = F.floor(F.log2(a))
    size = (e + 1100) * width + F.floor((a / F.pow(F.lit(2.0), e) - 1.0) * width)
    # the infinities lie outside all numbers and NaN, as in Spark's order, above them
    size = F.when(F.isnan(v), F.lit(2200 * width + 1)).when(a == float("inf"), F.lit(2200 * width)).when(a == 0, F.lit(0)).otherwise(size)
    return F.when(v < 0, -size).otherwise(size).cast("long")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi join on equally named keys.

    `null_safe` makes NULL match NULL (group keys of unknown origin); the plain form keeps the
    partitioning of earlier steps on the same keys.
    """
    if not keys:
        return attach(left, right)  # without keys both sides are one row
    if not null_safe:
        return left.join(right, list(keys), how)
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def unfolded(df: DataFrame) -> DataFrame:
    """Marks rows that `explode` has made, or that were stored tightly packed.

    The planner sizes them as the table (or the files) they come from, so it takes any number of them for small and collects
    them in the driver for a broadcast. Joins with them, also after further steps on this one table, shuffle both sides instead.
    """
    return df.hint("merge")


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deals few rows that are about to be exploded over four tasks a core; a given number is not merged again, however small the rows.

    By a hash of the keys: a repartition by the keys themselves is left out where an aggregate has just dealt the same number.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, F.xxhash64(*keys))


def group_starts(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """First rows of the groups of a table that is sorted by the keys."""
    new = np.zeros(len(t), bool)
    new[:1] = True
    for k in keys:
        c = t.column(k).combine_chunks()
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of a task, sorted by the keys, in tables that end with a group: a task holds a batch and a group."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        last = int(group_starts(held, keys)[-1]) if len(held) else 0  # more of the last group may follow
        if last:
            yield held.slice(0, last)
            held = held.slice(last).combine_chunks()
    if held is not None and len(held):
        yield held


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row table (totals, thresholds) to every row.

    The aggregate proves the size of what is broadcast; any other number of rows than one fails the job.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in one_row.columns])
    one = one_row.agg(F.count(F.lit(1)).alias("__n"), F.first(row).alias("__row"))
    failed = F.raise_error(F.concat(F.lit("a table of one row is asked for, this one has "), F.col("__n").cast("string")))
    one = one.select(F.when(F.col("__n") == 1, F.col("__row")).otherwise(failed).alias("__row"))
    return df.crossJoin(F.broadcast(one)).select(*[F.col(f"`{c}`") for c in df.columns], "__row.*")


def running_sums(
    df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str], ties: Sequence[str] = (), bits: int = 6
) -> DataFrame:
    """Adds, per output name, the sum of a column over all earlier rows and `<name>_total`.

    "Earlier" is ascending `order`, then `ties`; (keys, order, ties) must be unique.
    """
    kept = df.columns
    # a struct key is never NULL and equal to itself even with NULL fields, so groups with a NULL key
    # survive the join, and window, join and aggregate share one partitioning on (key, bucket)
    rows = df.withColumn(KEY, _key(keys)).withColumn(BUCKET, value_bucket(F.col(order), bits))
    per = rows.groupBy(KEY, BUCKET).agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    group = W.partitionBy(KEY)
    before = group.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select(
        KEY,
        BUCKET,
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
        *[F.sum(f"__s_{n}").over(group).alias(f"{n}_total") for n in sums],
    )
    inside = W.partitionBy(KEY, BUCKET).orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__i_{n}") for n, c in sums.items()])
    out = rows.join(offsets, [KEY, BUCKET])
    return out.select(*kept, *[(F.col(f"__i_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums], *[f"{n}_total" for n in sums])


def pearson(x, y) -> Column:
    """Correlation that is NULL, not an error, when a side has no spread."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n) with NULLs left out; the pre-aggregation all rank work starts from."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, bits: int = 6) -> DataFrame:
    """One row per distinct value: `n` ties, average `rank` (1-based) and group size `n_group`."""
    counted = cut(value_counts(df, keys, value))  # read twice below; storing it spares a second scan
    ran = running_sums(counted, keys, value, {"__before": "n"}, bits=bits)
    return ran.select(
        *keys,
        value,
        "n",
        (F.col("__before") + (F.col("n") + 1) / 2).alias("rank"),
        F.col("__before_total").alias("n_group"),
    )


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, bits: int = 6) -> DataFrame:
    """Row-level average-tie rank: ranks per distinct value joined back."""
    r = average_ranks(df, keys, value, bits).select(*keys, value, F.col("rank").alias(out))
    return join_on(df, r, [*keys, value], "left", null_safe=True)


def ordinal(df: DataFrame, keys: Sequence[str], order: str, out: str, ties: Sequence[str] = (), bits: int = 6) -> DataFrame:
    """Row number 1..n within keys by ascending `order` then `ties` (must be unique)."""
    ran = running_sums(df.withColumn("__one", F.lit(1).cast("long")), keys, order, {out: "__one"}, ties, bits)
    return ran.withColumn(out, F.col(out) + 1).withColumnRenamed(f"{out}_total", f"{out}_of").drop("__one")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], bits: int = 8) -> DataFrame:
    """Exact linearly interpolated quantiles of the finite values per group; `probs` maps output name to probability."""
    keys = list(keys)
    got = _weighted_quantiles(_finite_counts(df, keys, value), probs, bits)
    return got.select(*[F.col(f"{KEY}.{k}").alias(k) for k in keys], *probs)


def counted_quantiles(df: DataFrame, keys: Sequence[str], value: str, count: str, probs: dict[str, float], bits: int = 8) -> DataFrame:
    """`quantiles` of a table that has each value of a group once, with its count."""
    keys, v = list(keys), finite(F.col(value))
    got = _weighted_quantiles(df.where(v.isNotNull()).select(_key(keys).alias(KEY), v.alias("__v"), F.col(count).alias("__n")), probs, bits)
    return got.select(*[F.col(f"{KEY}.{k}").alias(k) for k in keys], *probs)


def _finite_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(key, value, n) of the finite values: all that order statistics need, counted before the shuffle."""
    v = finite(F.col(value))
    return df.where(v.isNotNull()).groupBy(_key(keys).alias(KEY), v.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))


def _weighted_quantiles(counts: DataFrame, probs: dict[str, float], bits: int) -> DataFrame:
    """(key, probs) of a table (key, __v, __n), values standing __n times.

    Bucket totals (small) say which buckets hold a wanted rank; only those buckets' values are then ordered, each bucket on its own.
    """
    rows = counts.withColumn(BUCKET, value_bucket(F.col("__v"), bits))
    per = rows.groupBy(KEY, BUCKET).agg(F.sum("__n").alias("__c"))
    group = W.partitionBy(KEY)  # the buckets of one group
    per = per.select(
        KEY, BUCKET, "__c",
        F.coalesce(F.sum("__c").over(group.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"),
        F.sum("__c").over(group).alias("__t"),
    )
    pos = {name: (F.col("__t") - 1) * F.lit(float(p)) for name, p in probs.items()}
    wanted = reduce(
        lambda a, b: a | b,
        [(F.col("__b") <= r) & (r < F.col("__b") + F.col("__c")) for p in pos.values() for r in (F.floor(p), F.ceil(p))],
    )
    near = rows.join(per.where(wanted).drop("__c"), [KEY, BUCKET]).groupBy(KEY, BUCKET, "__v", "__b", "__t").agg(F.sum("__n").alias("__n"))
    inside = W.partitionBy(KEY, BUCKET).orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    near = near.withColumn("__s", F.col("__b") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__s") <= rank) & (rank < F.col("__s") + F.col("__n")), F.col("__v")))

    ends = [e for name, p in pos.items() for e in (at(F.floor(p)).alias(f"__lo_{name}"), at(F.ceil(p)).alias(f"__hi_{name}"))]
    got = near.groupBy(KEY).agg(F.max("__t").alias("__t"), *ends)
    return got.select(
        KEY, *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * (p - F.floor(p))).alias(n) for n, p in pos.items()]
    )


def _middle(a: Column) -> Column:
    """Median of a sorted array, interpolated as in `quantiles`."""
    at = (F.size(a) - 1) * F.lit(0.5)
    lo, hi = F.element_at(a, (F.floor(at) + 1).cast("int")), F.element_at(a, (F.ceil(at) + 1).cast("int"))
    return lo + (hi - lo) * (at - F.floor(at))


def _small_median_mad(df: DataFrame, keys: Sequence[str], columns: Sequence[str], count: str | None) -> DataFrame:
    """`median_mad_columns` of groups that fit an array each: every row is moved once."""
    held = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.sort_array(F.collect_list(finite(F.col(c)))).alias(f"__a{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"__a{i}").alias("__a")) for i, c in enumerate(columns)])
    long = held.select(*keys, "__n", F.inline(rows)).where(F.size("__a") > 0).withColumn("median", _middle(F.col("__a")))
    long = long.withColumn("__d", F.sort_array(F.transform("__a", lambda v: F.abs(v - F.col("median")))))
    return long.select(*keys, "feature", "median", _middle(F.col("__d")).alias("mad"), *([F.col("__n").alias(count)] if count else []))


def median_mad_columns(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], count: str | None = None, bits: int = 8, most: int = 100_000
) -> DataFrame:
    """(keys, feature, median, mad) of the finite values of several columns at once; `count` adds the rows per group.

    Groups of at most `most` rows are gathered and sorted as arrays. Larger ones, found by a count of the rows beforehand, go
    through counts per value and buckets, so that no task holds them. Both give the same numbers.
    """
    keys = list(keys)
    if not keys:
        return _large_median_mad(df, keys, columns, count, bits)
    large = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).drop("__n"))
    if large.isEmpty():
        return _small_median_mad(df, keys, columns, count)
    small = _small_median_mad(join_on(df, large, keys, "left_anti", null_safe=True), keys, columns, count)
    return small.unionByName(_large_median_mad(join_on(df, large, keys, "left_semi", null_safe=True), keys, columns, count, bits))


def _large_median_mad(df: DataFrame, keys: Sequence[str], columns: Sequence[str], count: str | None, bits: int) -> DataFrame:
    """`median_mad_columns` from counts per value; deviations from the median come from the same counts, which are stored once."""
    keys = list(keys)
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, list(columns), "feature", "__x")
    counts = cut(_finite_counts(long, [*keys, "feature"], "__x"))
    med = _weighted_quantiles(counts, {"median": 0.5}, bits)
    dev = counts.join(med, KEY).select(KEY, F.abs(F.col("__v") - F.col("median")).alias("__v"), "__n")
    both = med.join(_weighted_quantiles(dev, {"mad": 0.5}, bits), KEY)
    out = both.select(*[F.col(f"{KEY}.{k}").alias(k) for k in keys], F.col(f"{KEY}.feature").alias("feature"), "median", "mad")
    return join_on(out, df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)), keys, null_safe=True) if count else out


def median_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and median absolute deviation of one column per group."""
    return median_mad_columns(df.select(*keys, value), keys, [value]).drop("feature")


def smallest(df: DataFrame, order: Sequence[str], n: int, most: int = 1_000_000) -> DataFrame:
    """The n first rows by ascending `order` (unique together), for any n, without sorting all of them in one task.

    Rows are counted per value bucket of the first column and the bucket that holds the n-th row is found. While that bucket has over `most`
    rows it is split by finer buckets, then by those of the next column. Each step is one job that hands the driver one row. Rows of
    earlier buckets are taken by a filter; only the bucket of the n-th row is sorted. Columns that are not numbers take part in that
    sort only. NULL and NaN follow as Spark orders them.
    """
    numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    rest, taken, inside, held = df, F.lit(False), F.lit(True), most + 1
    for column in order:
        if column not in numbers:
            break
        for b in (6, 22, 38):
            if held <= most:
                break
            bucket = F.coalesce(value_bucket(F.col(column), b), F.lit(-(1 << 62)))  # NULL sorts first
            per = rest.groupBy(bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
            # one window over the buckets of one bucket of the step before
            upto = F.sum("__c").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, 0))
            at = per.withColumn("__to", upto).where(F.col("__to") >= n).agg(F.min(F.struct("__to", "__b", "__c")).alias("m")).select("m.*").first()
            if at["__to"] is None:
                return df  # fewer than n rows in all
            low = bucket < at["__b"]
            taken, inside = taken | (inside & low), inside & (bucket == at["__b"])
            n, held, rest = n - (at["__to"] - at["__c"]), at["__c"], df.where(inside)
    return df.where(taken).unionByName(rest.orderBy(*order).limit(n))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group. Spark applies the limit on the map side before it shuffles."""
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
