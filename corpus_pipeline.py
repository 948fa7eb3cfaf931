"""A corpus pipeline: each stage takes the documents that the last one kept and returns the columns of documents.

Language ID, SimHash near-dedup, substring dedup, benchmark decontamination,
mixing to target weights. Every stage's docstring says what it keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import op2_simhash, op4_language, op7_substrings, op9_decontamination, op10_mixing
from quire.llm.common import written

#: Least share of a text's trigrams that its languages, all together, must explain.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text has no letters or no set of languages that explains half of it. Learned from those that are not held out."""
    return op4_language.explained(docs, docs.filter(~op4_language.held_out()), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return op2_simhash.representatives(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that occur earlier go; such texts become their other words, joined by spaces. All documents stay, if empty too."""
    return op7_substrings.deduplicated(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return op9_decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is taken: its columns, n_tokens and epoch."""
    return op10_mixing.mixed(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Language ID and SimHash are not expressible; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
