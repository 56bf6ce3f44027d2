"""The contract queries: one thin ``opN_<name>`` for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversations, cotraining, decontaminate, language_masks, licenses, piece_lattice, quality_rules, simhash, substring_dedup, token_grammar
from .common import read


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_grammar.digest(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_masks.held_out(read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(read(spark, sf_dir, "documents"))


def op4_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.encoded(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(read(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_maximal_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rendered(read(spark, sf_dir, "conversations"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_token_grammar, op2_language_masks, op3_substring_dedup, op4_piece_lattice, op5_simhash_groups, op6_decontaminate, op7_cotraining, op8_maximal_chats, op9_license_scan, op10_quality_rules)}
SQL: dict[str, str] = {"op3_substring_dedup": substring_dedup.SQL, "op8_maximal_chats": conversations.SQL, "op9_license_scan": licenses.sql()}
