"""A corpus pipeline of the optional operators: each stage is written as Parquet and read again by the next.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linestream.llm.common import settled, table
from linestream.llm.jaccard import keep_first
from linestream.llm.mixing import mixed_texts
from linestream.llm.packing import pack_documents
from linestream.llm.pii import redact
from linestream.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (4/5 of their 5-word n-grams shared) the one with the smallest id stays."""
    return keep_first(docs, 80, 5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become marks of their kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets: one row for each use of a document, with the words this use takes."""
    return mixed_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces of fixed-length sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: Boosted trees, pseudorandom draws and tokenizer ids have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def upto(n: int) -> DataFrame:
        """What the first ``n`` stages leave, written; what they wrote before, the table of the stage ahead included, is gone then."""
        if n == 0:
            return table(spark, sf_dir, "documents")
        return settled(lambda: STAGES[n - 1][1](spark, upto(n - 1), sf_dir), "stage")

    return STAGES[-1][1](spark, upto(len(STAGES) - 1), sf_dir)
