"""Top-k search against brute force, and what it opens and sends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import topk


def brute_topk(rows_, k):
    out = []
    for q, v in rows_:
        if q is None or q % 20 or v is None:
            continue
        scored = sorted((-int(np.dot(v, w)), i) for i, w in rows_ if i != q and i is not None)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [7, 10000])
def test_topk_ties_and_shards(spark, shard):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(90)] + [(i, [1.0, 0, 0, 0, 0]) for i in range(90, 150)]
    df = spark.createDataFrame([(i, [float(x) / 64 for x in v]) for i, v in vectors], "vec_id long, embedding array<float>")
    got = topk.exact_topk(df, F.col("vec_id") % 20 == 0, 6, shard_rows=shard, block_rows=3)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(vectors, 6)


def test_topk_awkward(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [1.0, None]), (None, [1.0, 1.0]), (5, [2.0]), (6, []), (7, [inf, 0.0]), (8, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in vectors], "vec_id long, embedding array<float>, row int, rank int")
    got = topk.exact_topk(df, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 8, 64 * 64 * 3), (0, 2, 5, 64 * 64 * 2), (0, 3, 6, 0)]
    assert topk.exact_topk(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("shard", [4, 10000])
def test_large_components(spark, shard):
    """Exact while a long holds the score, its nearest end beyond; others aren't disturbed."""
    rng = np.random.default_rng(6)
    vectors = {i: [float(x) for x in rng.integers(-50, 50, 3)] for i in range(30)}
    vectors |= {31: [2.0**30, 1.0, 0.0], 40: [1e30, 0.0, 1.0], 41: [-1e30, 5.0, 0.0], 42: [2.0**21 + 1, 3.0, 0.0], 60: [2.0**30 + 1, 7.0, 2.0], 61: [1e308, 0.0, 0.0]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 20 == 0, 9, scale=1.0, shard_rows=shard).collect())
    want = []
    for q in (i for i in vectors if i % 20 == 0):
        scored = []
        for i, v in vectors.items():
            exact = sum(int(a) * int(b) for a, b in zip(vectors[q], v, strict=True))
            scored.append((-min(max(exact, -(2**63)), 2**63 - 1), i))
        best = sorted(s for s in scored if s[1] != q)[:9]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def clustered(n, dim=3, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-4000, 4000, (24, dim))
    return (centres[rng.integers(0, 24, n)] + rng.integers(-40, 40, (n, dim))).astype(float)


def test_tree_has_tight_boxes_and_every_row_once():
    x = np.random.default_rng(1).integers(0, 3, (500, 4)).astype(float)
    tree = topk.kd_tree(x, 16)
    leaves = [r for r in tree.rows if r is not None]
    assert sorted(np.concatenate(leaves).tolist()) == list(range(500))
    assert all(len(v) <= 16 or np.ptp(x[v], axis=0).max() == 0 for v in leaves)
    for at, own in enumerate(tree.rows):
        if own is None:
            below = [tree.left[at], tree.right[at]]
            assert (tree.low[at] == tree.low[below].min(axis=0)).all() and (tree.high[at] == tree.high[below].max(axis=0)).all()
        else:
            assert (tree.low[at] == x[own].min(axis=0)).all() and (tree.high[at] == x[own].max(axis=0)).all()


def test_few_leaves_are_opened_where_boxes_tell():
    x = clustered(8000)
    ids = np.arange(len(x))
    q = x[::100]
    who, score, ident, _, opened = topk.search_shard(q, ids[::100], x, ids, ids, 5, leaf_rows=32)
    leaves = sum(r is not None for r in topk.kd_tree(x, 32).rows)
    assert opened < 0.1 * len(q) * leaves
    for n in range(len(q)):
        exact = x @ q[n]
        exact[n * 100] = -np.inf
        want = np.lexsort((ids, -exact))[:5]
        assert ident[who == n].tolist() == want.tolist() and score[who == n].tolist() == exact[want].tolist()
    reached = np.array([score[who == n][-1] for n in range(len(q))])
    again = topk.search_shard(q, ids[::100], x, ids, ids, 5, reached, leaf_rows=32)
    assert again[4] <= opened and (again[2] == ident).all()


def test_queries_go_to_few_shards(spark):
    x = clustered(6000) / 64
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sent = []
    got = topk.exact_topk(df, F.col("vec_id") % 20 == 0, 5, shard_rows=100, sent=sent).collect()
    assert len(got) == 300 * 5
    assert sum(sent) < 0.2 * 300 * 60


def test_a_shard_of_equal_vectors_is_split(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.when(F.col("id") % 3 == 0, 2.0).otherwise(F.col("id") / 100)).alias("embedding"))
    got = topk.exact_topk(df, F.col("vec_id") == 300, 3, shard_rows=64).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2999), (2, 2998), (3, 2996)]
