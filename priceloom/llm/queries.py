"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from priceloom.llm import (
    bpe_counts,
    capture_index,
    compression_bands,
    content_chunks,
    importance_resampling,
    jaccard_join,
    line_crf,
    one_permutation,
    pivot_codes,
    site_templates,
    source_mix,
    string_tiling,
    template_tree,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = line_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_crf.score_quality(docs, model).select("doc_id", "held_out", "score", "predicted", "n_lines")


def op4_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_tree.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "text")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compression_bands.compression_bands(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", *[f.name for f in compression_bands.FIELDS])


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_chunks.repeated_spans(documents(spark, sf_dir))


def op9_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index.archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_counts.token_counts(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_pivot_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_permutation.near_duplicates(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_string_tiling,
        op2_site_templates,
        op3_line_crf,
        op4_template_tree,
        op5_jaccard_join,
        op6_compression_bands,
        op7_mix_sources,
        op8_repeated_spans,
        op9_capture_index,
        op10_token_counts,
        op11_importance_resampling,
        op12_pivot_codes,
        op13_one_permutation,
    )
}
ORACLES: dict[str, str] = {
    "op4_template_tree": template_tree.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op7_mix_sources": source_mix.SQL,
    "op11_importance_resampling": importance_resampling.SQL,
    "op12_pivot_codes": pivot_codes.SQL,
    "op13_one_permutation": one_permutation.SQL,
}
