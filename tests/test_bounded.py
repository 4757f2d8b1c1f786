"""Plans whose tasks stay bounded, on awkward rows."""

import datetime

import duckdb
from pyspark.sql import functions as F

from evigraph.operators import graph as gr
from evigraph.operators import retrieval as rt
from evigraph.plans import PLANS, SQL, runner
from evigraph.sources.tables import Graph
from oracle import rows_of


def same(spark, folder, name):
    con = duckdb.connect()
    for table in ("events", "documents"):
        if (folder / f"{table}.parquet").exists():
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = runner(PLANS[name])(spark, str(folder))
    want = con.sql(SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_frame(spark, tmp_path):
    """Equal times, frame ends that are met exactly, empty hours and nulls; no task for a whole type."""
    start = datetime.datetime(2024, 1, 1)
    at = [0, 0, 1, 3599, 3600, 3600, 3601, 7199, 7200, 7201, 20000, 23600, 23601]
    rows = [(i, start + datetime.timedelta(seconds=s), k) for i, (s, k) in enumerate((s, k) for k in ("a", "b", None) for s in at)]
    rows += [(100 + i, None, k) for i, k in enumerate(("a", "a", "c", None))] + [rows[0]]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    plan = same(spark, tmp_path, "w11_range_frame")
    assert "RangeFrame" not in plan and "hour" in plan


def test_ngrams_are_counted_without_their_shuffle(spark, tmp_path):
    """Rows that repeat an id are one document; only texts are dealt."""
    rows = [(1, "a b c a b c a b"), (1, "a b c"), (2, "a b"), (3, None), (None, "x y z x y z"), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plan = same(spark, tmp_path, "b10_ngrams")
    assert plan.split("Initial Plan")[0].count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_validate_without_joins_of_edges(spark):
    """Null ends are missing; repeats of an edge count each but are one repeated edge."""
    nodes = spark.createDataFrame([("a", "part", "a"), ("a", "part", "a"), ("b", "moon", "b")], "node_id string, node_type string, name string")
    edges = [("a", "b", "order_has_part")] * 3 + [("a", "a", "x"), (None, "b", "order_has_part"), ("z", None, None)]
    edges = spark.createDataFrame(edges, "src string, dst string, rel string").withColumn("valid_time", F.lit(None).cast("date"))
    df = gr.validate_graph(Graph(nodes, edges))
    assert dict(tuple(r) for r in df.collect()) == {
        "unknown_type": 1, "repeated_node": 1, "missing_src": 2, "missing_dst": 1, "unknown_relation": 2, "repeated_edge": 1, "self_loop": 1,
    }
    assert "LeftOuter" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_graph_is_built_in_bounded_partitions(spark, data):
    from evigraph.sources.tables import Tables

    plan = gr.build_graph(Tables(spark, data)).edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2


def test_bm25_keeps_every_document(spark, tmp_path):
    """More documents than ten share the question's word; all of them are scored."""
    docs = [(i, "common word" + " filler" * i) for i in range(14)] + [(90, "nothing"), (91, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "A common one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = runner(PLANS["f07_bm25"])(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.doc_id) for r in got) == [(5, i) for i in range(14)]
    scores = [r.score for r in sorted(got, key=lambda r: r.doc_id)]
    assert scores == sorted(scores, reverse=True)


def test_page_rank_rounds_hold_what_is_led_to(spark, monkeypatch):
    """Nodes that no edge leads to aren't in the rounds' tables; repeats, unknown ends, nulls and loops."""
    nodes = [("hub",), ("end",), ("loop",), ("lonely",), ("end",)] + [(f"leaf{i}",) for i in range(40)]
    edges = [(f"leaf{i}", "hub") for i in range(40)] + [("leaf0", "hub"), ("leaf1", "end"), ("hub", "end"), ("loop", "loop"), ("hub", "gone"), ("gone", "end"), (None, "hub"), ("leaf2", None)]
    g = Graph(spark.createDataFrame([(n, "part", n) for (n,) in nodes], "node_id string, node_type string, name string"), spark.createDataFrame(edges, "src string, dst string"))
    sizes, stored = [], gr.as_table
    monkeypatch.setattr(gr, "as_table", lambda df: (sizes.append(df.count()) if df.columns == ["node_id", "got"] else None, stored(df))[1])
    got = {r.node_id: r["rank"] for r in gr.page_rank(g, 4).collect()}
    ids = {n for (n,) in nodes}
    out = {a: {b for x, b in edges if x == a} for a, _ in edges if a in ids}
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(4):
        new = {i: sum(rank[a] / len(bs) for a, bs in out.items() if i in bs) for i in ids}
        lost = 1 - sum(new.values())
        rank = {i: (0.15 + 0.85 * lost) / len(ids) + 0.85 * x for i, x in new.items()}
    assert got.keys() == ids and all(abs(got[i] - rank[i]) < 1e-12 for i in ids)
    assert sizes == [3] * 4


def test_bm25_deals_texts_once(spark, tmp_path, monkeypatch):
    """Terms and scores are grouped where a document's texts were dealt; rows that repeat an id are one document's."""
    docs = [(i % 7, f"common word{i % 3} " + "filler " * i) for i in range(20)] + [(2, "common word2 "), (2, "common word2 "), (None, "common"), (50, None), (51, ""), (52, "nothing")]
    items = [(5, "A common word2"), (6, "word0, filler!"), (7, ""), (8, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    want = con.sql(SQL["f07_bm25"])
    want = rows_of(want.columns, want.fetchall())
    df = runner(PLANS["f07_bm25"])(spark, str(tmp_path))
    assert rows_of(df.columns, df.collect()) == want
    plan = runner(PLANS["f07_bm25"])(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    path = plan[: plan.index("REPARTITION_BY_NUM")]
    assert "explode" in path and path.count("Exchange") == 1
    monkeypatch.setattr(rt, "MAX_TERMS", 1)
    df = runner(PLANS["f07_bm25"])(spark, str(tmp_path))
    assert rows_of(df.columns, df.collect()) == want
