"""The stored vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.operators import cells as ce
from evigraph.operators import retrieval as rt


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, a third of all rows alike, and rows that take no part."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.1 * rng.normal(size=8)).tolist()) for i in range(600)]
    rows += [(1000 + i, centres[0].tolist()) for i in range(300)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (None, [1.0] * 8), (2003, [None] + [1.0] * 7), (5, centres[5].tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def asked(vectors):
    return vectors.where("vec_id % 50 = 0 AND vec_id < 2000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def test_all_cells_are_exact(spark, vectors, tmp_path, monkeypatch):
    built = ce.build(vectors, str(tmp_path / "index"), 6)
    used = vectors.where("vec_id < 2000")
    want = sorted(map(tuple, rt.vector_topk(asked(vectors), used, 4).collect()))
    assert sorted(map(tuple, ce.search(built, asked(vectors), 4, 6).collect())) == want
    loaded = ce.load(spark, str(tmp_path / "index"))
    monkeypatch.setattr(ce, "MAX_QUERIES", 3)
    assert sorted(map(tuple, ce.search(loaded, asked(vectors), 4, 99).collect())) == want
    assert loaded.rows.count() == used.count()


def test_few_cells_find_nearly_all(vectors, tmp_path):
    built = ce.build(vectors, str(tmp_path / "index"), 12, sample_rows=400)
    exact = {tuple(r)[:1] + (r.vec_id,) for r in rt.vector_topk(asked(vectors), vectors.where("vec_id < 2000"), 5).collect()}
    got = {(r.query_id, r.vec_id) for r in ce.search(built, asked(vectors), 5, 2).collect()}
    assert len(exact & got) >= 0.9 * len(exact)


def test_probes_prune_partitions(vectors, tmp_path):
    built = ce.build(vectors, str(tmp_path / "index"), 12)
    one = asked(vectors).where("query_id = 50")
    plan = ce.search(built, one, 5, 1)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "cell#" in filters and plan.count("FileScan") == 1
    assert len(built.rows.select("cell").distinct().collect()) == 12


def test_nothing(spark, vectors, tmp_path):
    none = ce.build(vectors.limit(0), str(tmp_path / "none"), 3)
    assert ce.search(none, asked(vectors).limit(0), 3, 1).count() == 0
    assert ce.search(ce.build(vectors, str(tmp_path / "some"), 3), asked(vectors).limit(0), 3, 1).count() == 0
