"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import decontamination, metric_search, prefix_trie
from factorloom.llm.embedding_dedup import embedding_near_dedup
from factorloom.llm.html_text import extract_pages
from factorloom.llm.jaccard_groups import shingle_components
from factorloom.llm.language_model import lm_scores
from factorloom.llm.packing import pack_documents
from factorloom.llm.recompression import substring_dedup
from factorloom.llm.secret_scan import scan_secrets
from factorloom.llm.suffix_dedup import suffix_dedup
from factorloom.llm.token_alignment import align_tokens
from factorloom.llm.toxicity import toxicity_scores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_search.top_products(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_suffix_dedup, op2_ngram_jaccard, op3_substring_dedup, op4_best_two_fit, op5_secret_scan, op6_lm_scores, op7_toxicity, op8_html_text, op9_embedding_dedup, op10_spaced_seeds, op11_token_alignment, op12_prefix_trie, op13_exact_top_k]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op10_spaced_seeds": decontamination.ORACLE_SQL, "op12_prefix_trie": prefix_trie.ORACLE_SQL, "op13_exact_top_k": metric_search.ORACLE_SQL}
