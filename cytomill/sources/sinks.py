"""Writers. Tables are partitioned by the key later reads filter on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_expression(expr: DataFrame, path: str, by: str | None = None) -> None:
    w = expr.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def write_named(tables: dict[str, DataFrame], root: str, by: dict[str, str] | None = None) -> None:
    """Several result tables under one root, some partitioned."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(by[name]) if by and name in by else w).parquet(f"{root}/{name}")


def write_rows(df: DataFrame, path: str, append: bool = False) -> None:
    """Per-image rows as CSV with a header."""
    df.write.mode("append" if append else "overwrite").csv(path, header=True)


def write_metrics(long: DataFrame, path: str) -> None:
    """`metric value` text lines."""
    long.select(F.concat_ws(" ", "metric", F.col("value").cast("string")).alias("value")).write.mode("overwrite").text(path)


def outline_lines(points: DataFrame, keys: Sequence[str], points_col: str = "points") -> DataFrame:
    """One line x,y,x,y,... per object."""
    flat = F.flatten(F.transform(points_col, lambda p: F.array(p.x.cast("int"), p.y.cast("int"))))
    return points.select(*keys, F.array_join(F.transform(flat, lambda v: v.cast("string")), ",").alias("line"))


def write_outlines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)
