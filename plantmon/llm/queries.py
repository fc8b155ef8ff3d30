"""The operators as queries over the given tables, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plantmon.llm import decontaminate, hard_negatives, html_text, jaccard, language_id, line_dedup, neighbours, packing, prefix_trie, quality, sharding, substring_dedup, suffix_tree
from plantmon.llm.common import read_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.query(read_table(spark, sf_dir, "documents"))


def op2_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.query(read_table(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(read_table(spark, sf_dir, "documents"))


def op4_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.query(read_table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(read_table(spark, sf_dir, "documents"))


def op6_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(read_table(spark, sf_dir, "documents"))


def op8_byte_cnn_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.query(read_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.query(read_table(spark, sf_dir, "documents"))


def op10_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.query(read_table(spark, sf_dir, "documents"))


def op11_bond_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.query(read_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.query(read_table(spark, sf_dir, "conversations"))


def op13_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_adaptive_dimension_scan, op3_line_dedup, op4_site_template_removal, op5_best_fit_packing, op6_wu_manber_decontamination, op7_balanced_label_propagation, op8_byte_cnn_language_id, op9_ngram_jaccard_join, op10_suffix_tree_scoring, op11_bond_hard_negatives, op12_prefix_trie, op13_adaptive_quality_rules)
}
SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op6_wu_manber_decontamination": decontaminate.SQL,
    "op9_ngram_jaccard_join": jaccard.SQL,
    "op11_bond_hard_negatives": hard_negatives.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_adaptive_quality_rules": quality.SQL,
}
