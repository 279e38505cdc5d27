"""Image and mask listings as tables of paths: filtering, pairing, per-study rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytomill.functions import scalar as sc
from cytomill.operators.ordered import join_on

# fixed values: image extensions and the name endings of files that are no images
IMAGE_EXT = ["png", "jpg", "jpeg", "tif", "tiff", "flex", "dax", "nd2", "nrrd"]
MASK_ENDINGS = ["_cp_output", "_flows", "_flows_0", "_flows_1", "_flows_2", "_cellprob", "_masks"]


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, size, modified of every file; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def describe(files: DataFrame) -> DataFrame:
    """Adds folder, stem and extension."""
    p = F.col("path")
    return files.select("*", F.regexp_replace(p, "/[^/]*$", "").alias("folder"), sc.file_stem(p).alias("stem"), sc.file_ext(p).alias("ext"))


def image_files(files: DataFrame, mask_filter: str = "_masks", suffix: str = "") -> DataFrame:
    """Images by extension, without masks and flows, once each."""
    d = describe(files).where(F.col("ext").isin(IMAGE_EXT))
    for end in [*MASK_ENDINGS, mask_filter]:
        d = d.where(~F.endswith("stem", F.lit(end)))
    if suffix:
        d = d.where(F.endswith("stem", F.lit(suffix)))
    return d.dropDuplicates(["path"])


def natural_key(c: Column) -> Column:
    """Sort key that orders embedded numbers by value: every digit run without leading zeros, behind its length in ten places."""
    digits = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda d: F.regexp_replace(d, "^0+(?=.)", ""))
    words = F.split(c, r"\d+")
    sized = lambda d: F.concat(F.lpad(F.length(d).cast("string"), 10, "0"), d)
    return F.array_join(F.zip_with(words, digits, lambda w, d: F.concat(F.coalesce(w, F.lit("")), F.coalesce(sized(d), F.lit("")))), "")


def label_files(images: DataFrame, files: DataFrame, mask_filter: str = "_masks", priority: Sequence[str] = ("tif", "tiff", "png")) -> DataFrame:
    """Image path with its label path (first extension in priority order) and flow path, NULL when absent."""
    rank = F.array_position(F.array(*[F.lit(e) for e in priority]), F.col("ext"))
    d = describe(files).where(F.col("ext").isin(*priority)).withColumn("__p", rank)

    def having(ending: str, name: str) -> DataFrame:
        f = d.where(F.endswith("stem", F.lit(ending))).withColumn("__s", sc.strip_suffix(F.col("stem"), ending))
        return f.groupBy("folder", F.col("__s").alias("stem")).agg(F.min_by("path", F.struct("__p", "path")).alias(name))

    i = images.select("path", "folder", "stem")
    j = join_on(join_on(i, having(mask_filter, "label_path"), ["folder", "stem"], "left"), having("_flows", "flow_path"), ["folder", "stem"], "left")
    return j.select("path", "label_path", "flow_path")


def all_flows_present(labels: DataFrame) -> DataFrame:
    """One row: flows are used only if every image has one."""
    return labels.agg(F.bool_and(F.col("flow_path").isNotNull()).alias("use_flows"))


def with_mask_and_flow(files: DataFrame) -> DataFrame:
    """Images that have both `<stem>_mask` and `<stem>_mask_flows` beside them."""
    d = describe(files)

    def stems(ending: str) -> DataFrame:
        return d.where(F.endswith("stem", F.lit(ending))).select("folder", sc.strip_suffix(F.col("stem"), ending).alias("stem"))

    plain = d.where(~F.endswith("stem", F.lit("_mask")) & ~F.endswith("stem", F.lit("_mask_flows")))
    return join_on(join_on(plain, stems("_mask"), ["folder", "stem"], "left_semi"), stems("_mask_flows"), ["folder", "stem"], "left_semi")


def study_pairs(images: DataFrame, masks: DataFrame, studies: Sequence[str] | None = None) -> DataFrame:
    """Images with a mask of the same (last folder, stem); the study is the folder text before '-'."""
    def keyed(df: DataFrame) -> DataFrame:
        d = describe(df).withColumn("leaf", F.regexp_extract("folder", r"([^/]*)$", 1))
        return d.withColumn("study", F.split_part("leaf", F.lit("-"), F.lit(1)))

    i, m = keyed(images), keyed(masks).withColumn("stem", sc.strip_suffix(F.col("stem"), "_mask"))
    if studies is not None:
        i = i.where(F.col("study").isin(*studies))
    return join_on(i, m.select("leaf", "stem"), ["leaf", "stem"], "left_semi").select("study", "leaf", "stem", "path")


def pair_by_order(images: DataFrame, masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tiles and masks of a folder paired by sorted order; different counts fail the job.

    Window groups are the files of one folder.
    """
    def numbered(df: DataFrame, name: str) -> DataFrame:
        w = W.partitionBy(*keys).orderBy("path")
        return df.select(*keys, F.col("path").alias(name), F.row_number().over(w).alias("k"))

    a, b = numbered(images, "image_path"), numbered(masks, "mask_path")
    j = a.join(b, [*keys, "k"], "full")
    ok = F.assert_true(F.col("image_path").isNotNull() & F.col("mask_path").isNotNull(), F.lit("image and mask counts differ"))
    return j.withColumn("__ok", ok).where("__ok is null").drop("__ok", "k")


def locate(names: DataFrame, files: DataFrame, name: str = "file", priority: Sequence[str] = ("tif", "tiff", "png", "jpg")) -> DataFrame:
    """Path of each named image: same name whatever the case, else same stem by extension priority."""
    d = describe(files).withColumn("lname", F.lower(sc.file_name(F.col("path")))).withColumn("lstem", F.lower("stem"))
    pos = F.array_position(F.array(*[F.lit(e) for e in priority]), F.col("ext"))
    d = d.withColumn("__p", F.when(pos == 0, len(priority) + 1).otherwise(pos))
    full = d.groupBy("lname").agg(F.min("path").alias("p1"))
    stem = d.groupBy("lstem").agg(F.min_by("path", F.struct("__p", "path")).alias("p2"))
    n = names.withColumn("lname", F.lower(name)).withColumn("lstem", F.when(~F.contains(F.col(name), F.lit(".")), F.lower(name)))
    return n.join(full, "lname", "left").join(stem, "lstem", "left").select(*names.columns, F.coalesce("p1", "p2").alias("path"))


def keep_channels(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages whose channel the study keeps; pages are grouped by channel, so channel = page / (pages / channels).

    `rules` (study, keep array, n_channels) has a row per study and is sized by the planner.
    """
    per = F.floor(F.col("n_pages") / F.col("n_channels"))
    ch = F.floor(F.col("page") / F.nullif(per, F.lit(0)))
    return pages.join(rules, "study").withColumn("channel", ch).where(F.array_contains("keep", F.col("channel").cast("int"))).drop("keep", "n_channels")


def split_subset(names: DataFrame, position: int, tokens: Sequence[str] | str, name: str = "name") -> DataFrame:
    """Rows whose n-th underscore token is listed; 'ALL' keeps everything."""
    return names if tokens == "ALL" else names.where(F.get(F.split(name, "_"), position).isin(*tokens))


def ready_fields(files: DataFrame, keys: Sequence[str], channel: str, required: Sequence[str]) -> DataFrame:
    """Per field: whether all required channels arrived and which are missing."""
    req = F.array(*[F.lit(c) for c in required])
    g = files.where(F.col(channel).isin(*required)).groupBy(*keys).agg(F.collect_set(channel).alias("have"))
    missing = F.array_sort(F.array_except(req, F.col("have")))
    return g.select(*keys, (F.size(missing) == 0).alias("ready"), missing.alias("missing"))


def plate_files(fields: DataFrame, keys: Sequence[str], columns: Sequence[str], channels: dict[str, str]) -> DataFrame:
    """Wide channel file columns to (keys, channel, raw name, normalised name)."""
    long = fields.unpivot(list(keys), list(columns), "column", "raw").where("raw is not null and raw <> ''")
    ch = F.element_at(F.create_map(*[F.lit(x) for kv in channels.items() for x in kv]), F.col("column"))
    idx = F.regexp_extract("column", r"(\d+)$", 1)
    return long.select(*keys, ch.alias("channel"), "raw", F.concat(F.lower(F.regexp_replace("raw", r"\.[^.]*$", "")), F.lit("_w"), idx, F.lit(".tif")).alias("name"))
