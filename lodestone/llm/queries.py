"""Queries opN_<name> of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import alignment, bytecnn, html, language, linededup, media, merkle, mixing, negatives, packing, quality_rules, simhash, suffixes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file that a query uses, the packing query's if none is named; another path can be passed to an operator."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.page_audit(_table(spark, sf_dir, "pages"))


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(_table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(_table(spark, sf_dir, "documents"))


def op6_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op7_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_templates, op2_mix_sources, op3_merkle_fixity, op4_byte_cnn, op5_quality_rules, op6_html_template, op7_simhash_trie, op8_pack_best_fit, op9_suffix_dedup, op10_media_columns, op11_align_tokenizers, op12_hard_negatives, op13_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op3_merkle_fixity": merkle.SQL, "op12_hard_negatives": negatives.SQL}
