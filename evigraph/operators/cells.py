"""A stored vector index: rows in cells around coarse centres.

Centres are found by k-means over a bounded sample; every row is then put into the
cell of its nearest centre. The cells are the partitions of a table, so a search
that probes some cells reads their folders only. A cell is no unit of work: a
large one is read in as many splits as its files have, and each split keeps a
query's best ``k``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.operators.retrieval import Best, tiles
from evigraph.sources.shared import as_table

#: Rows that the centres are fitted on, and queries that are sent to the tasks at once.
SAMPLE_ROWS = 100_000
MAX_QUERIES = 4096


@dataclass
class Cells:
    """``rows``: ``vec_id, embedding, cell``; ``centres``: a unit vector for each cell."""

    rows: DataFrame
    centres: np.ndarray


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; rows without a length become NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows whose id and numbers are there, of some length."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(finite & F.exists(x, lambda c: c != 0)).select("vec_id", "embedding")


def fit_centres(vectors: DataFrame, cells: int, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> np.ndarray:
    """Unit centres of ``cells`` clusters of at most ``sample_rows`` rows, chosen by a hash of the id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    used = _usable(vectors)
    n = used.count()
    share = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < (1 << 20) * sample_rows / max(n, 1)
    sample = as_table(used.where(share).limit(sample_rows).select(array_to_vector("embedding").alias("features")))
    if sample.isEmpty():
        return np.zeros((1, 1))
    model = KMeans(k=cells, seed=seed, maxIter=20, distanceMeasure="cosine").fit(sample)
    return _unit(np.array(model.clusterCenters(), np.float64))


def build(vectors: DataFrame, path: str, cells: int, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Cells:
    """Write the index of ``vectors`` (vec_id, embedding) to ``path``.

    Every row with a usable vector is in one cell; rows with a null id, or a
    vector that is null, of no length or holds a null or non-finite number, are
    in none. Repeated rows are kept. All vectors have one dimension.
    """
    spark = vectors.sparkSession
    centres = fit_centres(vectors, cells, sample_rows, seed)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=np.argmax(_unit(_matrix(b["embedding"])) @ centres.T, axis=1).astype(np.int32))

    placed = _usable(vectors).mapInPandas(place, "vec_id long, embedding array<float>, cell int")
    # By cell and a salt, so that a cell is in one or a few files and a hot one in several.
    placed.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(4))).write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(json.dumps(centres.tolist()),)], "centres string").write.parquet(f"{path}/centres")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Cells:
    centres = np.array(json.loads(spark.read.parquet(f"{path}/centres").first()["centres"]))
    return Cells(spark.read.schema("vec_id long, embedding array<float>, cell int").parquet(f"{path}/rows"), centres)


def search(index: Cells, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """The best ``k`` of each query in its ``probes`` nearest cells: ``query_id, rank, vec_id, score``.

    Scores are cosines rounded to six places, ties go to the smaller id, and a
    query's own row is left out. With all cells probed the result is exact.
    Only the folders of probed cells are read. ``queries`` (query_id, q) is a
    stated set, taken in blocks of at most ``MAX_QUERIES``; of queries that
    repeat an id one is taken.
    """
    spark = index.rows.sparkSession
    asked = queries.where("query_id IS NOT NULL AND q IS NOT NULL").select("query_id", "q").dropDuplicates(["query_id"])
    asked = as_table(asked)
    blocks = -(-asked.count() // MAX_QUERIES)
    schema = "query_id long, vec_id long, score double"
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").collect()
        if not rows:
            continue
        ids, matrix = np.array([r["query_id"] for r in rows], np.int64), _unit(np.array([r["q"] for r in rows], np.float64))
        near = np.argsort(-(matrix @ index.centres.T), axis=1, kind="stable")[:, :probes]
        asking = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        probed = index.rows.where(F.col("cell").isin(sorted(asking)))
        out = out.unionByName(probed.mapInPandas(_best_of_cells(ids, matrix, asking, k), schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _best_of_cells(ids: np.ndarray, matrix: np.ndarray, asking: dict[int, np.ndarray], k: int):
    """Each task keeps a query's best of a cell, scored in tiles of a bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, Best] = {}
        for b in batches:
            for cell, own in b.groupby("cell"):
                who = asking[int(cell)]
                kept = best.setdefault(int(cell), Best(len(who), k))
                for tile in tiles(len(who), len(own)):
                    part = own.iloc[tile]
                    vec = part["vec_id"].to_numpy()
                    score = np.round(matrix[who] @ _unit(_matrix(part["embedding"])).T, 6)
                    score[(ids[who][:, None] == vec[None, :]) | ~np.isfinite(score)] = -np.inf
                    kept.add(score, vec)
        for cell, kept in best.items():
            yield kept.found(ids[asking[cell]])

    return run
