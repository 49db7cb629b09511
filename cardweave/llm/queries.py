"""The queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardweave.llm import clustering, decontaminate, html, linededup, neardup, packing, quality, secrets, suffixdedup, toxicity, urlfilter, vectordedup, whitening

Query = Callable[[SparkSession, str], DataFrame]

# Fixed rules of the URL filter's query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(_table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"), rules)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("items").alias("item_ids"), "n_matched", (F.col("n_matched") > 0).alias("contaminated"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.drop("n_tokens").withColumnRenamed("id", "doc_id")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates_digest(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return linededup.dedup_lines(docs).select("doc_id", "n_deleted", F.length("text").alias("n_kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_digest(_table(spark, sf_dir, "embeddings"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_digest(_table(spark, sf_dir, "embeddings"))


def op13_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordedup.near_vectors_digest(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scans": op1_secret_scans,
        "op2_url_filters": op2_url_filters,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_suffix_array_dedup": op5_suffix_array_dedup,
        "op6_minhash_neardup": op6_minhash_neardup,
        "op7_quality_rules": op7_quality_rules,
        "op8_line_dedup": op8_line_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_html_extraction": op10_html_extraction,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_embedding_neardup": op13_embedding_neardup,
        "pipeline": pipeline,
    }
