"""The corpus pipeline: five stages, each a llm operator over all that the stage before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, which is written as Parquet to the
shared folder and read again as the next stage's documents. All stages but the last keep the columns of
``documents``.

Defined results: an empty table stays empty through all stages; nulls, ties and repeated rows are as each
operator's module states; extra columns ride along to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontam, mix, neardup, rules, tokens
from quire.llm.queries import read, tokenizer_path
from quire.llm.store import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or a risk-controlled cutoff rejects go."""
    return rules.keep_good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays: the first."""
    return neardup.drop_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; a document stands as often as the mix takes it."""
    return mix.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Directly addressable codes of the mix; one row a document as read back from the files."""
    return tokens.read(spark, tokens.write(docs, tokenizer_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: Learned lexicons, similarity classes and a tokenizer are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
