"""From raw documents to sharded training data, in five stages of the operators of ``cueline.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``.  Null and empty texts, repeated rows and empty tables go through every stage as its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cueline.llm.common import stored
from cueline.llm.decontamination import decontaminated
from cueline.llm.mixing import mixed_documents
from cueline.llm.nearcopies import without_near_copies
from cueline.llm.sharding import uniform_shards
from cueline.llm.toxicity import without_toxic

SHARDS = 24


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learner rejects go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: similarity 0.8 or more of the 5-word shingles, verified on the texts."""
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document taken several times is as many rows."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are shuffled into shards of equal size, with ``shard`` and ``slot``."""
    return uniform_shards(docs, SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("simhash", simhash),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Learning, fingerprints and seeded choices are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; every stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = stored(docs)
    return docs
