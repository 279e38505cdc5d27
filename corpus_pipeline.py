"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, secrets, piece ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns
of `documents`; extra columns of docs are carried along.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import cytomill
from cytomill.llm import decontaminate, neardup, pieces, queries, rules, secrets
from cytomill.llm.wordhash import settle

# Python workers then need no copy of the package on their path
cloudpickle.register_pickle_by_value(cytomill)


def _packed(docs: DataFrame) -> DataFrame:
    """Whole rows in one struct, so that no column of an operator clashes with theirs."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def _with_text(packed: DataFrame, text: F.Column) -> DataFrame:
    """The rows with a new text and its length."""
    changed = F.col("row").withField("text", text)
    return packed.select(changed.withField("n_chars", F.length(text).cast("long")).alias("row")).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rule and whose posterior quality, from votes over all rows, is at least one half."""
    measured = _packed(docs).withColumn("measures", rules.measures(F.col("row.text")))
    return rules.judge(measured, rules.fit(measured)).where("verdict.kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest doc_id."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages that benchmark windows cover; rows of which no word remains go.

    The hits are written before texts are cut, so that no task holds two Python workers.
    """
    packed = _packed(docs).withColumn("text", F.col("row.text"))
    hits = decontaminate.with_hits(packed, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
    hits = settle(hits).withColumn("text", F.col("row.text"))
    covered = F.aggregate(F.col("hits.spans"), F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    some = hits.where((covered == 0) | (covered < F.col("hits.n_words")))
    return _with_text(decontaminate.remove_hits(some), F.col("text"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with a mark in the place of each secret."""
    packed = _packed(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    found = secrets.scan_versions(packed, carry=("row",))
    return _with_text(found, secrets.redact(F.col("row.text"), F.col("spans")))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces, lossless): sampled piece ids of each text and whether they decode to it."""
    vocabulary = pieces.Pieces(queries.PIECE_MODEL)
    d = docs.select("doc_id", pieces.encode_checked(spark, F.col("doc_id"), F.col("text"), vocabulary).alias("sample"))
    return d.select("doc_id", "sample.ids", F.size("sample.ids").cast("long").alias("n_pieces"), "sample.lossless")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("piece_ids", piece_ids),
]

#: Votes, classes and samples have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage reads what the one before it wrote to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
