"""Streams replayed from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomill.plans.regions import CLIP, SIDE, points
from cytomill.plans.registry import Tables, query, r, rnd
from cytomill.plans.shapes import runs
from cytomill.operators import overlap as ov
from cytomill.session import cut
from cytomill.streaming import incremental as inc


def replay(t: Tables, df: DataFrame, parts: int = 4, order: str | None = None) -> DataFrame:
    """The rows as a file stream of one batch per part (in time order when `order` is given)."""
    p = inc.scratch(t.spark, "replay")
    if order:  # one write after the other, as the source takes files by their age
        ranged = cut(df.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()))
        for k in range(parts):
            ranged.where(F.col("__part") == k).drop("__part").coalesce(1).write.mode("append").parquet(p)
    else:
        df.repartition(parts).write.parquet(p)
    return inc.file_stream(t.spark, p, df.schema, 1)


@query("t01_append_metrics", "select c_custkey, c_acctbal from customer")
def _(t):
    d = t.customer.select("c_custkey", "c_acctbal")
    s = replay(t, d.unionByName(d))
    return inc.append_metrics(s, ["c_custkey"], inc.scratch(t.spark, "metrics")).select("c_custkey", "c_acctbal")


@query("t02_unique_fields", "select distinct user_id, event_type from events")
def _(t):
    s = inc.unique_fields(replay(t, t.events.select("user_id", "event_type", "ts"), 4, "ts"), ["user_id", "event_type"], "ts", "60 days")
    return inc.run_to_table(s, inc.scratch(t.spark, "fields")).select("user_id", "event_type")


@query("t03_readiness", "select user_id, count(distinct event_type) filter (event_type in ('click', 'view')) = 2 as ready from events group by 1")
def _(t):
    s = inc.readiness(replay(t, t.events.select("user_id", "event_type", "ts"), 4, "ts"), ["user_id"], "event_type", ["click", "view"], "ts", "60 days", "365 days")
    return inc.latest(inc.run_to_table(s, inc.scratch(t.spark, "ready"), "update"), ["user_id"])


@query("t04_running_counts", f"with {CLIP} select image_id, label, count(*) as n from asg group by 1, 2")
def _(t):
    s = replay(t, ov.place_points(points(t), "clip", SIDE, SIDE))
    return inc.latest(inc.run_to_table(inc.running_counts(s, runs(t)), inc.scratch(t.spark, "counts"), "update"), ["image_id", "label"])


@query("t05_tumbling", f"select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, {r('sum(value)')} as total from events group by 1, 2")
def _(t):
    s = inc.windowed(replay(t, t.events, 4, "ts"), "ts", "1 day", None, ["event_type"], "value", "2 days")
    return inc.latest(inc.run_to_table(s, inc.scratch(t.spark, "tumble"), "update"), ["start", "event_type"]).withColumn("total", rnd("total"))


@query("t05_sliding", f"with w as (select time_bucket(interval '1 day', ts) - k * interval '1 day' as start, value from events, (select unnest([0, 1]) as k)) select start, count(*) as n, {r('sum(value)')} as total from w group by 1")
def _(t):
    s = inc.windowed(replay(t, t.events, 4, "ts"), "ts", "2 days", "1 day", [], "value", "3 days")
    return inc.latest(inc.run_to_table(s, inc.scratch(t.spark, "slide"), "update"), ["start"]).withColumn("total", rnd("total"))


@query("t05_sessions", """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from g)
  select min(ts) as start, user_id, count(*) as n from s group by user_id, k""")
def _(t):
    p, one = inc.scratch(t.spark, "replay"), t.events.select("user_id", "ts")
    one.repartitionByRange(3, "ts").write.parquet(p)
    for days in (400, 401):  # two later arrivals move the watermark past the last session
        one.agg(F.lit(None).cast(one.schema["user_id"].dataType).alias("user_id"), (F.max("ts") + F.expr(f"interval {days} days")).alias("ts")).write.mode("append").parquet(p)
    s = inc.sessions(inc.file_stream(t.spark, p, one.schema, 1), "ts", "6 hours", ["user_id"], "60 days")
    return inc.run_to_table(s, inc.scratch(t.spark, "sess")).where("user_id is not null").select("start", "user_id", "n")
