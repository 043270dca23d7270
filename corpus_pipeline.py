"""The training-data pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.llm.common import written
from priceloom.llm.compression_bands import compression_bands
from priceloom.llm.jaccard_join import jaccard_components
from priceloom.llm.source_mix import mix_plan, mixed_documents
from priceloom.llm.string_tiling import decontaminated
from priceloom.llm.template_tree import dedup_lines

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands keep; null and empty texts fail the base rules."""
    return compression_bands(docs).where("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines, with their new length; a document that loses all of its lines goes. Null texts
    stay as they are, equal rows lose the same lines."""
    cut = dedup_lines(docs).where("n_dropped = 0 OR n_dropped < n_lines")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the smallest row by (doc_id, hash of the text); of rows that share both the one
    with the smallest hash of all columns. Texts without words are no duplicates of each other unless they share both."""
    found = jaccard_components(docs).where("is_first").select(F.col("doc_id").alias("stays"), "text_hash")
    first = written(found.groupBy("stays", "text_hash").count(), "stays")
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col("stays")) & (text_hash == F.col("text_hash"))
    alone = docs.join(first.where("count = 1"), same, "left_semi")
    again = written(first.where("count > 1"), "stays-again")
    if again.isEmpty():
        return alone
    # Only rows that are there several times are grouped.
    one = docs.join(again, same).groupBy("stays", again["text_hash"]).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return alone.unionByName(one.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, equal rows share their fate."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their copies and taken words; a null source is a source, a text without words adds none.
    Empty tables stay empty in every stage, and other columns pass through."""
    return mixed_documents(docs, mix_plan(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: Compression and tiling can't be expressed in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
