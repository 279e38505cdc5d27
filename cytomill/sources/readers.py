"""Readers: explicit schemas, column projection, no inference over data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytomill.functions import scalar as sc

# fixed values: column layout of the published tables
TRANSCRIPTS = ("transcript_id long, cell_id string, overlaps_nucleus int, feature_name string, x_location double, y_location double, "
               "z_location double, qv float, fov_name string, nucleus_distance float, codeword_index int")
CELLS = "cell_id string, x_centroid double, y_centroid double, transcript_counts int, cell_area double, nucleus_area double"
VERTICES = "cell_id string, vertex_x double, vertex_y double"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) matches anything, on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_transcripts(spark: SparkSession, path: str, columns: Sequence[str] | None = None, min_qv: float = 0.0, qv: str = "qv") -> DataFrame:
    """Parquet points; the quality filter and the projection reach the scan."""
    df = spark.read.parquet(path)
    if min_qv > 0 and qv in df.columns:
        df = df.where(F.col(qv) >= min_qv)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", partitions: int | None = None) -> DataFrame:
    """CSV with a given schema; `partitions` spreads an unsplittable gzip file after the scan."""
    df = spark.read.csv(path, schema=schema, header=True, sep=sep)
    return df.repartition(partitions) if partitions else df


def read_cells(spark: SparkSession, path: str, schema: str = CELLS, partitions: int | None = None) -> DataFrame:
    return read_csv(spark, path, schema, partitions=partitions)


def read_boundaries(spark: SparkSession, path: str, columns: Sequence[str] = ("cell_id", "vertex_x", "vertex_y")) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def expand_csc(indptr: DataFrame, entries: DataFrame, column: str = "col", size: int = 4096) -> DataFrame:
    """Triplets from a column-compressed matrix: indptr (col, start, stop) and entries (pos, row, value).

    The range join runs on position bins, so a long column spreads over many tasks.
    """
    p = indptr.where("stop > start").withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))
    e = entries.withColumn("__b", F.floor(F.col("pos") / size))
    return e.join(p, "__b").where("pos >= start and pos < stop").select(column, "row", "value")


def read_gene_panel(spark: SparkSession, path: str) -> DataFrame:
    """Gene names of a JSON panel whose payload is a list of names, a list of objects, or a `features` list."""
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("j"))
    lists = F.coalesce(
        F.try_variant_get("j", "$.payload.targets", "array<variant>"), F.try_variant_get("j", "$.payload", "array<variant>"),
        F.try_variant_get("j", "$.features", "array<variant>"), F.try_variant_get("j", "$", "array<variant>"),
    )
    item = text.select(F.explode(lists).alias("v"))
    return item.select(F.coalesce(
        F.try_variant_get("v", "$.type.data.name", "string"), F.try_variant_get("v", "$.name", "string"), F.try_variant_get("v", "$", "string")
    ).alias("gene")).where("gene is not null")


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One-row experiment metadata, an empty table when the file is absent."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Temp views for a bundle of tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + n for n in tables]


def read_field_table(spark: SparkSession, path: str, columns: Sequence[str], site: str = "site") -> DataFrame:
    """All-string CSV, trimmed, missing as '', site number without its leading letter."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, schema=schema, header=True)
    df = df.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in columns])
    return df.withColumn(site, F.nullif(F.regexp_replace(site, "^s+", ""), F.lit("")).cast("int"))


def read_feature_files(spark: SparkSession, paths: Sequence[str], schema: str, pattern: str = r"plate=([^/]+)") -> DataFrame:
    """Union of the per-plate files that exist; the plate comes from the path."""
    here = [p for p in paths if exists(spark, p)]
    if not here:
        raise FileNotFoundError(f"none of {list(paths)} exists")
    df = spark.read.csv(here, schema=schema, header=True)
    return df.withColumn("plate", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_counts(spark: SparkSession, path: str, extra: int = 1) -> DataFrame:
    """TSV truth: file and one or more counts, the mean of the non-empty ones; text that is no number fails the job."""
    cols = [f"count{i}" for i in range(1, extra + 1)]
    df = spark.read.csv(path, schema="file string, " + ", ".join(f"{c} string" for c in cols), header=True, sep="\t")
    vals = F.filter(F.array(*[F.nullif(F.trim(c), F.lit("")).cast("double") for c in cols]), lambda v: v.isNotNull())
    total = F.aggregate(vals, F.lit(0.0), lambda a, b: a + b)
    return df.select("file", F.when(F.size(vals) > 0, total / F.nullif(F.size(vals), F.lit(0))).alias("gt"))


def read_table_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    return spark.read.csv(path, schema=schema, header=True) if exists(spark, path) else None


def require_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet profile table; a clear error when it is absent."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


POINTS = "array<array<double>>"
POLYGON_JSON = (
    "imageHeight int, imageWidth int, shapes array<struct<points:array<array<double>>>>, "
    "item struct<slots:array<struct<height:int,width:int>>>, annotations array<struct<polygon:struct<paths:array<array<struct<x:double,y:double>>>>>>"
)


def polygon_vertices(docs: DataFrame, keys: Sequence[str], json: str = "json") -> DataFrame:
    """Vertices (keys, label, ord, x, y, height, width) of annotation JSON in either dialect.

    The n-th polygon is label n; of a path list only the outer path is used.
    """
    j = docs.select(*keys, F.from_json(json, POLYGON_JSON).alias("j"))
    first = F.transform("j.shapes", lambda s: F.transform(s.points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    second = F.transform("j.annotations", lambda a: a.polygon.paths[0])
    slot = F.get(F.col("j.item.slots"), 0)
    j = j.select(*keys, F.coalesce("j.imageHeight", slot.height).alias("height"), F.coalesce("j.imageWidth", slot.width).alias("width"), F.coalesce(first, second).alias("polys"))
    p = j.select(*keys, "height", "width", F.posexplode("polys").alias("n", "pts"))
    v = p.select(*keys, "height", "width", (F.col("n") + 1).cast("long").alias("label"), F.posexplode("pts").alias("ord", "pt"))
    return v.select(*keys, "label", F.col("ord").cast("long").alias("ord"), F.col("pt.x").alias("x"), F.col("pt.y").alias("y"), "height", "width")


def coco_annotations(docs: DataFrame, files: DataFrame, keys: Sequence[str], json: str = "json") -> DataFrame:
    """Annotations joined to their image files by name: (file_name, annotation_id, points flat list).

    `keys` name the document, in which alone image ids are unique.
    """
    schema = "images array<struct<id:long,file_name:string>>, annotations array<struct<id:long,image_id:long,segmentation:array<array<double>>>>"
    j = docs.select(*keys, F.from_json(json, schema).alias("j"))
    img = j.select(*keys, F.inline("j.images")).withColumnRenamed("id", "image_id")
    ann = j.select(*keys, F.inline("j.annotations")).withColumnRenamed("id", "annotation_id")
    return ann.join(img, [*keys, "image_id"]).join(files.select("file_name").distinct(), "file_name", "left_semi").select(
        "file_name", "annotation_id", F.flatten("segmentation").alias("points")
    )


def block_index(names: DataFrame, path: str = "path") -> DataFrame:
    """Block position from file names such as ..._Z000Y001X002."""
    return names.select("*", *[F.regexp_extract(path, sc.BLOCK_INDEX, g).cast("long").alias(a) for g, a in ((2, "bz"), (4, "by"), (6, "bx"))])
