"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that a plan broadcasts by itself.
MAX_ROWS = 10_000


def fits(df: DataFrame, most: int = MAX_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than it must."""
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small, and as it is if not: Spark
    then chooses a shuffle or, without an equality, a blocked product."""
    return F.broadcast(df) if fits(df, most) else df


#: Rows of a partition that is grouped or sorted in memory.
PART_ROWS = 400_000


def dealt(df: DataFrame, rows: int, *keys: str, each: int = PART_ROWS) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as ``rows`` asks for, so that what a
    task groups or sorts is bounded: partitions of a given number aren't merged by
    their compressed size, which says little of repeated keys."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-rows // each)), *keys)


#: Documents, and bytes of their texts, whose terms a task groups.
TASK_DOCS = 2048
TASK_BYTES = 8 << 20


def text_tasks(spark: SparkSession, n: int, size: int) -> int:
    """Tasks for ``n`` documents of ``size`` bytes of texts, each of a bounded number and size."""
    return max(spark.sparkContext.defaultParallelism, -(-n // TASK_DOCS), -(-size // TASK_BYTES))


def dealt_texts(docs: DataFrame, n: int, size: int, *keys: str) -> DataFrame:
    """``docs`` (of ``n`` rows and ``size`` bytes of texts) by ``keys``, so that a task
    groups the terms of a bounded number of texts. Texts are dealt, not their terms: a
    task that deals to more than 200 others holds all that it deals, and the terms of
    a file's share of texts are ten times its size."""
    return docs.repartition(text_tasks(docs.sparkSession, n, size), *keys)
