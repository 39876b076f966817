"""Training-corpus pipeline: quality rules, line dedup, near-duplicate dedup, mixing, packing.

Each stage takes the columns of ``documents`` and others under any names, and returns all of them but the last, which returns the
pieces. Edge cases, beside those of the operators: the quality stage drops null and empty texts and those of fewer than ten words;
the line stage keeps them as they are, and n_chars too; the near-duplicate stage keeps one of all texts without a word and of rows that share an
id and text; the mixing stage repeats or leaves out documents as their source's target asks, and draws documents without a word like
others; the packing stage gives a null or empty text the end token alone. An empty table goes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import linededup, mixing, packing, quality_rules, simhash
from lodestone.llm.queries import tokenizer_path
from lodestone.sources.scratch import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak supervision keeps."""
    return quality_rules.keep(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates; n_chars follows the text."""
    return linededup.without_templates(docs, length_col="n_chars")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates: five-word shingles, similarity 0.8."""
    return simhash.one_of_each(docs, shingle=5, most=20, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, shuffled within its output shard."""
    return mixing.copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Hash order, estimation and packing can't be put into SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
