"""A corpus pipeline over `documents`: each stage applies one operator of tessel.llm to what the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last keep the columns of
documents; the last one encodes what is left. Toxic and contaminated documents go, of each group of
n-gram near duplicates one document stays, and personal data is redacted in the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import bpe, decontaminate, ngram_join, pii, toxicity
from tessel.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is under the rejection level."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates: five-word shingles, Jaccard of 0.8 or more."""
    return ngram_join.keep_first(docs, shingle=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by marks."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each text's ids."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("pii", redact),
    ("bpe", encode),
]
#: Learned scores decide which rows are left, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
