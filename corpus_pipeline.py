"""From raw documents to packed token ids, in five stages.

Each stage takes what the one before has kept, written as Parquet and read
again, and returns the columns of documents; the last returns packed rows.

Every stage judges rows one by one, repeated ids and null ids among them, and texts
whole, however long; an empty table gives no rows, and extra columns go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.llm.decontamination import decontaminated
from lyrebird.llm.jaccard import deduplicated
from lyrebird.llm.mixing import mixed_documents
from lyrebird.llm.packing import packed_ids
from lyrebird.llm.quality import score_quality, train
from lyrebird.staging import staged, table

#: documents scored lower go
LEAST_QUALITY = 0.5


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes; it learns from the labels of those it may learn from.

    Null and empty texts have a score too, that of no features, and stay or go by it;
    equal texts have equal scores.  Without labels of both classes all texts have the
    same score.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    score = "_score"
    while score in docs.columns:
        score += "_"
    return score_quality(docs, model, score=score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    The least id stays, and of one id the least digest of a text.  Unlinked texts stay
    though they share an id; of rows of one id and text one stays; null ids all do.
    """
    return deduplicated(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs; null and empty texts, and all where the benchmark has no words."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def weighted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is one of its own.  A document without words is taken as often as
    its source's rate asks; a source without words is not taken.
    """
    return mixed_documents(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in rows of fixed length; a null or empty text is its end mark alone, and repeated rows are packed each."""
    return packed_ids(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_documents),
    ("mixing", weighted_documents),
    ("packing", packed_documents),
]

#: hinge-loss fitting and tokenization are not SQL; the tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
