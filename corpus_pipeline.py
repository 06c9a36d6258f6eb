"""A training corpus from raw documents: five operators of larkspur.llm, one after another.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. A
caller may write each stage's result and give the next one what it reads back. Every stage
gives an empty result of the same columns for an empty table, keeps columns of any name, and
takes texts of any length whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import bpe, decontaminate, ngram_join, pii, quality_classifier
from larkspur.llm._shared import written
from larkspur.llm.queries import VOCABULARY


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null, empty and blank texts go. Repeated rows share one verdict. A null id is kept or goes
    by its text like any other; a null host or path is a site of its own. Log odds of exactly 0
    are kept. Without labels of both qualities every text with a word stays.
    """
    return quality_classifier.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the least id.

    Texts without a word are no copies of each other. Of rows that share an id one stays;
    rows without an id all stay.
    """
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; repeated rows stay or go together. Null and
    empty items are not looked for.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, with personal data replaced by its kind.

    Null texts stay null and empty ones empty; repeated rows are changed alike. Of candidates
    that overlap the more likely one is taken, of equally likely ones the longer, then the
    one further left.
    """
    return pii.redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts, digests and ids of each document's tokens.

    A null text is empty and has no tokens; of equal pairs in a piece the leftmost merges
    first; repeated rows give repeated results.
    """
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("byte-level BPE", token_ids),
]

#: Classifier, chosen paths and boosted trees are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("-", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
