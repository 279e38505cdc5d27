"""Registry of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the tables of one data folder: `t.lineitem`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers `fn(t: Tables) -> DataFrame` under `name`."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; the nudge makes decimal ties fall the same way in both engines."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), digits) + F.lit(0.0)


def r(expr: str, digits: int = 6) -> str:
    """The SQL side of `rnd`."""
    return f"round(({expr}) + 1e-9, {digits}) + 0.0"


def scorr(x: str, y: str) -> str:
    """SQL correlation that is NULL when a side has no spread."""
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def t_tail(t: str, dof: str) -> str:
    """SQL for the two-sided Student tail: Simpson's rule on the angle form of the density."""
    theta = f"atan(abs({t}) / sqrt({dof}))"
    total = (
        f"list_sum(list_transform(range(0, 401), lambda i: (case when i = 0 or i = 400 then 1 when i % 2 = 1 then 4 else 2 end)"
        f" * pow(cos({theta} * i / 400.0), {dof} - 1)))"
    )
    return f"(1 - 2 * exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt(pi()) * {theta} / 1200.0 * {total})"


def z_tail(z: str) -> str:
    """SQL for the two-sided normal tail by Simpson's rule."""
    a = f"least(abs({z}), 40.0)"
    total = (
        f"list_sum(list_transform(range(0, 2001), lambda i: (case when i = 0 or i = 2000 then 1 when i % 2 = 1 then 4 else 2 end)"
        f" * exp(-pow({a} * i / 2000.0, 2) / 2.0)))"
    )
    return f"(1 - 2 / sqrt(2 * pi()) * {a} / 6000.0 * {total})"
