"""Session helpers: suggested settings and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are tuned for; a cluster's own values win.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the bin joins are followed by an aggregation on other keys, so splitting
    # a skewed partition is worth one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(master: str = "local[8]", app: str = "cueline", **conf: str) -> SparkSession:
    """A session with the recommended settings, for tests and the bench."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where none is set, a folder of our own, on a local master alone: executors of a cluster
    would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table written to the shared folder.

    Used where a result is read several times (an iteration, or a chain of
    operators that each read their input twice).  The files outlive a lost
    executor, later readers take only the columns they need, and the planner
    knows the real size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cueline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Leaf relations a plan may hold before reading it twice costs more than
#: writing it once.
CHEAP_LEAVES = 2


def settle(df: DataFrame, leaves: int = CHEAP_LEAVES) -> DataFrame:
    """``df`` ready to be read more than once.

    A plan over a few tables is simply evaluated again.  A deeper one (an
    operator applied to the result of other operators) is cut, because every
    operator that reads its input twice would double the work below it.
    """
    plan = df._jdf.queryExecution().analyzed()
    return df if plan.collectLeaves().size() <= leaves else cut_lineage(df)
