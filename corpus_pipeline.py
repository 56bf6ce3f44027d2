"""Corpus pipeline over ``documents``: five stages, each one operator of ``gridquorum.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridquorum.llm import cotraining, decontaminate, piece_lattice, simhash, substring_dedup
from gridquorum.llm.common import Work, read
from gridquorum.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return cotraining.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays."""
    return simhash.keep_first(docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut out of the text."""
    return substring_dedup.cut(docs)


def leaked_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, restored, ids of each document."""
    return piece_lattice.encoded(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_text", repeated_text), ("leaked_items", leaked_items), ("pieces", pieces)]

#: SQL can express neither the classifier nor the lattice; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = list(Work.live)
        docs = work.save(stage(spark, docs, sf_dir), name)
        for done in [w for w in Work.live if w not in before]:
            done.close()
    return STAGES[-1][1](spark, docs, sf_dir)
