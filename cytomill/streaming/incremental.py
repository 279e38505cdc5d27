"""Structured Streaming versions of the incremental steps.

Every job uses `availableNow`, so it catches up and stops; state and progress live under the
shared checkpoint folder, and each batch writes files keyed by its batch id, so a replay overwrites
instead of duplicating.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cytomill.session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_table(stream: DataFrame, target: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream until its input is used up; each batch overwrites its own folder `batch=<id>`.

    The table is the union of the batches, so only what append and update modes hand over can be kept.
    """
    if mode not in ("append", "update"):
        raise ValueError(f"batches of mode {mode} do not add up to a table")
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    q = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint or f"{target}-progress").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(_with_batch(stream)).option("basePath", target).parquet(target)


def _with_batch(stream: DataFrame):
    return T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])


def latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final value per key of an update-mode table: the row of the last batch."""
    rest = [c for c in updates.columns if c not in keys and c != "batch"]
    one = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__s"))
    return one.select(*keys, "__s.*")


def append_metrics(stream: DataFrame, keys: Sequence[str], target: str, compute: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Per-image rows appended once per key, also over restarts: a key already written is skipped."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = (compute(batch) if compute else batch).dropDuplicates(list(keys))
        try:
            done = spark.read.parquet(target).where(F.col("batch") != batch_id).select(*keys)
        except Exception as e:  # nothing was written so far
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = None
        new = rows if done is None else rows.join(done, list(keys), "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}-progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(target)


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Event time as an instant; tables may hold it without a zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def unique_fields(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """Each field once, with state bounded by the watermark."""
    return _timed(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def readiness(stream: DataFrame, keys: Sequence[str], channel: str, required: Sequence[str], time: str, delay: str, hold: str) -> DataFrame:
    """(keys, ready) of every field whose channels changed (update mode).

    The state of a field is the set of required channels that came, wherever their times lie; it is let go when
    the watermark has passed the field's last arrival by `hold`.
    """
    schema = [stream.schema[k] for k in keys]
    wanted, hold_ms = frozenset(required), int(pd.Timedelta(hold).total_seconds() * 1000)
    out = T.StructType([*schema, T.StructField("ready", T.BooleanType())])
    held = T.StructType([T.StructField("have", T.ArrayType(T.StringType())), T.StructField("last", T.LongType())])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        have, last = state.get if state.exists else ([], 0)
        have = set(have)
        for b in batches:
            have |= wanted & set(b["__channel"])
            last = max(last, int(b["__ms"].max()))
        state.update((sorted(have), last))
        state.setTimeoutTimestamp(max(last + hold_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, have == wanted)], columns=[*keys, "ready"])

    s = _timed(stream, time).withWatermark(time, delay)
    s = s.select(*keys, time, F.col(channel).cast("string").alias("__channel"), F.unix_millis(time).alias("__ms"))
    return s.groupBy(*keys).applyInPandasWithState(update, out, held, "update", GroupStateTimeout.EventTimeTimeout)


def running_counts(stream: DataFrame, runs: DataFrame, img: Sequence[str] = ("image_id",)) -> DataFrame:
    """Points per region as they arrive: stream-static region join, then a streaming count (update mode)."""
    from cytomill.operators.overlap import assign_points

    return assign_points(stream, runs, img).groupBy(*img, "label").agg(F.count(F.lit(1)).alias("n"))


def windowed(stream: DataFrame, time: str, size: str, slide: str | None, by: Sequence[str], value: str, delay: str) -> DataFrame:
    """Tumbling or sliding counts and sums."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    g = _timed(stream, time).withWatermark(time, delay).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, by: Sequence[str], delay: str) -> DataFrame:
    """Sessions in append mode: each is handed over once, when the watermark has passed its end."""
    g = _timed(stream, time).withWatermark(time, delay).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").cast("timestamp_ntz").alias("start"), *by, "n")
