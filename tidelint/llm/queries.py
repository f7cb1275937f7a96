"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelint.llm import divergence_rules, lexical_search, license_dice, line_spread, order_minhash, page_content, piece_codec, pivot_neighbours, prefix_trie, quality_bayes, repeat_blocks, residual_packing, topk_index
from tidelint.llm.frames import table


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_index.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op2_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bayes.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encoded(table(spark, sf_dir, "documents"), keep=False)


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.spread_report(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_dice.scanned(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op7_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_packing.packed(table(spark, sf_dir, "documents"))


def op8_page_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_content.main_text(table(spark, sf_dir, "pages"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeat_blocks.repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules.judged(table(spark, sf_dir, "documents")).drop("character_distance", "word_distance")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def op13_pivot_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_neighbours.linked(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_top_k, op2_quality_bayes, op3_piece_codec, op4_line_spread, op5_license_scan, op6_near_duplicates, op7_residual_packing, op8_page_content,
    op9_repeated_passages, op10_divergence_rules, op11_lexical_search, op12_prefix_trie, op13_pivot_neighbours)}

SQL: dict[str, str] = {
    "op1_top_k": topk_index.SQL,
    "op4_line_spread": line_spread.SQL, "op5_license_scan": license_dice.SQL, "op10_divergence_rules": divergence_rules.SQL,
    "op11_lexical_search": lexical_search.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_pivot_neighbours": pivot_neighbours.SQL}
