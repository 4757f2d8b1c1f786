"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    The setting is read from the session. Where it is unset, a folder of this
    machine is chosen in local mode, as in tests; on a cluster, where executors
    could not see it, ``RuntimeError`` is raised.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="evigraph-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has."""
    return f"{shared_dir(spark).rstrip('/')}/evigraph-{uuid.uuid4().hex}"


def as_table(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again: its
    lineage is cut, and it survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
