"""Paths that respect time, and the interval of a gain."""

import datetime
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.operators import evaluation as ev
from evigraph.operators import graph as gr
from evigraph.sources.tables import Graph

DAY = datetime.date


@pytest.fixture(scope="module")
def graph(spark):
    """a to b in May and b to c in March: c isn't reached that way, but over d in July."""
    edges = [("a", "b", DAY(2020, 5, 1)), ("b", "c", DAY(2020, 3, 1)), ("a", "d", DAY(2020, 6, 1)), ("d", "c", DAY(2020, 7, 1)), ("c", "e", None), ("b", "f", DAY(2020, 5, 1)), ("f", "d", DAY(2020, 5, 2))]
    edges += [("e", "a", DAY(2020, 8, 1)), ("b", "g", DAY(2020, 4, 30))]
    nodes = [(x, "t", x) for x in "abcdefgh"]
    return Graph(spark.createDataFrame(nodes, "node_id string, node_type string, name string"), spark.createDataFrame([(a, b, "r", t) for a, b, t in edges], "src string, dst string, rel string, valid_time date"))


def test_time_does_not_go_back(graph):
    got = {r.node_id: r.arrival for r in gr.earliest_arrival(graph, ["a"], 9, "2020-01-01").collect()}
    assert got == {"a": DAY(2020, 1, 1), "b": DAY(2020, 5, 1), "f": DAY(2020, 5, 1), "d": DAY(2020, 5, 2), "c": DAY(2020, 7, 1), "e": DAY(2020, 7, 1)}
    by_window = {r.node_id for r in gr.expand(graph, ["a"], 9, "2020-01-01", "2020-12-31", "out").collect()}
    assert by_window == set(got) | {"g"}


def test_hops_and_start(graph):
    few = {r.node_id: r.arrival for r in gr.earliest_arrival(graph, ["a"], 1, "2020-01-01").collect()}
    assert few == {"a": DAY(2020, 1, 1), "b": DAY(2020, 5, 1), "d": DAY(2020, 6, 1)}
    late = {r.node_id for r in gr.earliest_arrival(graph, ["a", "c"], 5, "2020-12-01").collect()}
    assert late == {"a", "c", "e"}
    assert gr.earliest_arrival(graph, ["unknown"], 3).count() == 0


def test_bootstrap_by_hand(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.random()), float(rng.random()) + 0.2) for i in range(40)] + [(99, None, 1.0), (98, 0.5, None)]
    got = ev.paired_bootstrap(spark.createDataFrame(rows, "query_id long, a double, b double"), 60).first()
    means = []
    for r in range(1, 61):
        w = [sum(int(hashlib.md5(f"{q}:{r}".encode()).hexdigest()[:8], 16) / 2**32 >= x for x in ev.POISSON) for q, _, _ in rows[:40]]
        means.append(sum(x * (b - a) for x, (_, a, b) in zip(w, rows[:40], strict=True)) / sum(w))
    assert got.n_queries == 40 and got.gain == pytest.approx(np.mean([b - a for _, a, b in rows[:40]]), abs=1e-6)
    assert (got.low, got.high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1e-6)
    assert got.low < got.gain < got.high


def test_poisson_weights(spark):
    """Of mean and variance one."""
    u = spark.range(200000).select((F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32).alias("u"))
    w = sum((F.when(F.col("u") >= x, 1.0).otherwise(0.0) for x in ev.POISSON), F.lit(0.0))
    mean, var = u.select(w.alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert mean == pytest.approx(1, abs=0.01) and var == pytest.approx(1, abs=0.02)
