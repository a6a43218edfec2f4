"""Five operators over documents, each stage's result written and read again as the next one's input.

Nulls, empty and very long texts, repeated rows and extra columns are treated as each operator's docstring says: null
and short texts go with the base rules of the first stage, rows repeated with equal ids stay together, columns other than those
an operator reads pass through untouched up to the last stage, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnsift.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from tarnsift.llm.common import materialize, table
from tarnsift.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", benchmark),
    ("byte_bpe", tokens),
]

#: Covariance steps, near-duplicate components and byte-pair merges are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
