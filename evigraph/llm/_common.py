"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.sources.shared import as_table, shared_dir

__all__ = ["WORD", "as_table", "checkpointed", "documents", "partitions", "pieces", "text_bytes"]

#: A word: a run of bytes outside the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts (one aggregate row)."""
    got = docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"]
    return int(got or 0)


def pieces(total: float, each: float) -> int:
    """How many pieces of ``each`` hold ``total``; 1 at least."""
    return max(1, math.ceil(total / each))
