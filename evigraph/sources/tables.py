"""Parquet tables, other file formats, JDBC and the graph's node and edge tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.errors import IndexUnavailable

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns are pushed into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Tables:
    """The tables of a folder as attributes: ``t.orders``."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return load(self.spark, self.sf_dir, name)

    def view(self, *names: str) -> SparkSession:
        """Register tables for ``spark.sql`` and return the session."""
        for n in names:
            load(self.spark, self.sf_dir, n).createOrReplaceTempView(n)
        return self.spark


def load_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A relational table; ``partition`` is (column, lower, upper, parts)."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, lower, upper, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.load()


def load_file(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options: str) -> DataFrame:
    """CSV, JSON, ORC, text, binary files or Parquet. CSV and JSON want a schema."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def load_vectors(spark: SparkSession, path: str, column: str = "embedding") -> DataFrame:
    """Vectors as a Parquet array column; missing ones are error 3003."""
    try:
        vectors = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise IndexUnavailable(path) from e
    if column not in vectors.columns:
        raise IndexUnavailable(path)
    return vectors


@dataclass(frozen=True)
class Graph:
    """Typed nodes (node_id, node_type, name) and edges (src, dst, rel, valid_time)."""

    nodes: DataFrame
    edges: DataFrame


def load_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def write_graph(graph: Graph, path: str, kind: str = "parquet") -> None:
    """Nodes by type and edges by relation, so that a reader prunes by either."""
    graph.nodes.write.mode("overwrite").format(kind).partitionBy("node_type").save(f"{path}/nodes")
    graph.edges.write.mode("overwrite").format(kind).partitionBy("rel").save(f"{path}/edges")


def manifest(df: DataFrame, name: str, layer: str, version: str, key: str) -> DataFrame:
    """One row for a table: rows, distinct keys and an order-free checksum.

    The checksum sums 48 bits of the MD5 of each row's columns as text, joined
    by ``|``; floating-point numbers have four places, nulls are empty.
    """
    text = lambda c, kind: F.col(c).cast("decimal(18,4)" if kind in ("double", "float") else kind).cast("string")
    row_hash = F.md5(F.concat_ws("|", *[F.coalesce(text(c, kind), F.lit("")) for c, kind in df.dtypes]))
    return df.agg(
        F.lit(name).alias("name"), F.lit(layer).alias("layer"), F.lit(version).alias("version"),
        F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.sum(F.conv(F.substring(row_hash, 1, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias("checksum"),
    )
