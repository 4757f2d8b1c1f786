"""Small cases worked out by hand, plans, streams and sources."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evigraph.errors import IndexUnavailable
from evigraph.functions import text as tx
from evigraph.operators import evaluation as ev
from evigraph.operators import graph as gr
from evigraph.operators import retrieval as rt
from evigraph.sources import tables as src
from evigraph.sources import web
from evigraph.streaming import windows as sw


@pytest.fixture(scope="module")
def tiny(spark):
    """a -> b -> c -> a, and b -> d later than the rest."""
    nodes = spark.createDataFrame([(x, "part", x) for x in "abcde"], "node_id string, node_type string, name string")
    edges = [("a", "b", "1994-01-01"), ("b", "c", "1994-02-01"), ("c", "a", None), ("b", "d", "1996-01-01")]
    return src.Graph(nodes, spark.createDataFrame([(s, d, "order_has_part", t) for s, d, t in edges], "src string, dst string, rel string, valid_time string").withColumn("valid_time", F.to_date("valid_time")))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_expand_counts_least_hops(tiny):
    assert got(gr.expand(tiny, ["a"], 3, direction="out")) == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]


def test_expand_in_time(tiny):
    assert got(gr.expand(tiny, ["a"], 3, "1994-01-01", "1994-12-31", "out")) == [("a", 0), ("b", 1), ("c", 2)]


def test_paths_have_no_cycle(tiny):
    assert got(gr.paths(tiny, "a", "d", 4, "out")) == [("a>b>d", 2)]
    assert got(gr.paths(tiny, "a", "d", 4, "both")) == [("a>b>d", 2), ("a>c>b>d", 3)]


def test_common_neighbors(tiny):
    assert got(gr.common_neighbors(tiny, ["a", "d"])) == [("b",)]


def test_validate_finds_dangling(spark, tiny):
    bad = tiny.edges.unionByName(spark.createDataFrame([("a", "zz", "no_such", None)], "src string, dst string, rel string, valid_time date"))
    found = dict(got(gr.validate_graph(src.Graph(tiny.nodes, bad))))
    assert (found["missing_dst"], found["unknown_relation"], found["missing_src"]) == (1, 1, 0)
    none = dict(got(gr.validate_graph(src.Graph(tiny.nodes.limit(0), tiny.edges.limit(0)))))
    assert len(none) == 7 and not any(none.values())


def test_graph_round_trip(spark, tiny, tmp_path):
    src.write_graph(tiny, str(tmp_path))
    back = src.load_graph(spark, str(tmp_path))
    assert got(back.edges.select("src", "dst", "rel", "valid_time").na.fill({})) and back.nodes.count() == 5


def test_fuse_prefers_agreement(spark):
    a = spark.createDataFrame([(1, 1, 7), (1, 2, 8)], "query_id long, rank long, doc_id long")
    b = spark.createDataFrame([(1, 1, 8), (1, 2, 9)], "query_id long, rank long, doc_id long")
    rows = rt.fuse({"x": a, "y": b}, 2).orderBy("rank").collect()
    assert [(r.doc_id, r.channel) for r in rows] == [(8, "x+y"), (7, "x")]


def test_recall(spark):
    gold = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "query_id long, doc_id long")
    hits = spark.createDataFrame([(1, 1), (1, 9), (2, 5)], "query_id long, doc_id long")
    row = ev.full_evidence_recall(hits, gold).first()
    assert (row.n_queries, row.mean_recall, row.complete_recall) == (2, 0.75, 0.5)


def test_chunks_cover_text(spark):
    docs = spark.createDataFrame([(1, "x" * 1234), (2, ""), (3, "y" * 500)], "doc_id long, text string")
    rows = tx.chunk(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("s"))
    assert got(rows) == [(1, 3, 1234 + 100), (2, 1, 0), (3, 1, 500)]


def test_short_passages_are_found(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two"), (2, "b c d e f g")], "item_id long, text string")
    assert got(tx.locate_spans(docs, items)) == [(1, 1, 5), (2, 2, 3)]


def test_more_queries_than_a_block(spark, data, monkeypatch):
    vectors = src.load(spark, data, "embeddings").limit(60)
    asked = vectors.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    want = got(rt.vector_topk(asked, vectors, 3))
    monkeypatch.setattr(rt, "MAX_QUERIES", 4)
    assert got(rt.vector_topk(asked, vectors, 3)) == want and len(want) == 27
    assert rt.vector_topk(asked.limit(0), vectors, 3).count() == 0


def test_missing_index(spark, tmp_path):
    with pytest.raises(IndexUnavailable) as e:
        src.load_vectors(spark, str(tmp_path / "none"))
    assert e.value.code == 3003


def test_failed_fetch_is_a_row(spark):
    row = web.fetch(spark, ["http://127.0.0.1:9/none"], 1).first()
    assert row.status is None and row.error


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF text")
    row = web.parse_files(spark, str(tmp_path), lambda b: b.decode()).first()
    assert (row.length, row.text) == (9, "%PDF text")


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    for kind in ("csv", "json", "orc"):
        df.write.format(kind).save(str(tmp_path / kind))
        assert got(src.load_file(spark, str(tmp_path / kind), kind, "k long, v string").na.fill("-")) == [(1, "a"), (2, "-")]


def test_filter_and_columns_reach_the_scan(spark, data):
    plan = entry.queries()["p03_pushdown"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1]


def test_stream_equals_batch(spark, data, tmp_path):
    events = src.load(spark, data, "events").repartition(3)
    events.write.parquet(str(tmp_path / "in"))
    stream = sw.tumbling(sw.timed(sw.read_events(spark, str(tmp_path / "in"))))
    table = sw.run_once(stream, str(tmp_path / "run"), "complete")
    batch = sw.tumbling(src.load(spark, data, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    assert got(table) == got(batch)


def test_stateful_counts(spark, data, tmp_path):
    src.load(spark, data, "events").repartition(2).write.parquet(str(tmp_path / "in"))
    table = sw.run_once(sw.running_counts(sw.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "run"), "update")
    last = sw.latest(table, ["user_id"])
    assert got(last) == got(src.load(spark, data, "events").groupBy("user_id").count())


def test_stream_dedup(spark, data, tmp_path):
    e = src.load(spark, data, "events")
    e.unionByName(e).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sw.deduplicated(sw.timed(sw.read_events(spark, str(tmp_path / "in")), "400 days"), ["event_id"]).select("event_id")
    assert sw.run_once(stream, str(tmp_path / "run"), "append").count() == e.count()


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(str(tmp_path / "in"))
    stream = sw.read_events(spark, str(tmp_path / "in")).select("event_id")
    assert sw.run_once(stream, str(tmp_path / "run"), "append").count() == 0


def test_scans_grow_linearly_with_hops(spark, data):
    g = gr.build_graph(src.Tables(spark, data))
    for hops in (1, 2, 3):
        plan = gr.expand(g, ["r1"], hops, direction="in")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") <= hops + 1


def test_components_of_the_graph(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefgz"], "node_id string")
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "c"), ("f", "e"), ("e", "e")], "src string, dst string")
    assert got(gr.components(nodes, edges)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "e"), ("g", "g"), ("z", "z")]


def test_page_rank_sums_to_one(spark, tiny):
    ranks = dict(got(gr.page_rank(tiny, 30)))
    assert sum(ranks.values()) == pytest.approx(1) and set(ranks) == set("abcde")
    # b by hand: a's only link, half of nothing else; a: c's only link
    lost = ranks["d"] + ranks["e"]
    assert ranks["b"] == pytest.approx(0.03 + 0.85 * (ranks["a"] + lost / 5), abs=1e-3)
    assert ranks["c"] == pytest.approx(0.03 + 0.85 * (ranks["b"] / 2 + lost / 5), abs=1e-3)


def test_both_ways_to_locate_agree(spark):
    docs = spark.createDataFrame([(1, "é one two three four five six seven"), (2, "a b c d e f g a b c d e f"), (3, None), (4, "")], "doc_id long, text string")
    items = [(1, "two"), (2, "b c d e f g"), (3, "a b c d e f"), (4, "one two three four five six"), (5, "a b c d e f"), (6, None), (7, "zz")]
    items = spark.createDataFrame(items, "item_id long, text string")
    one, other = tx.locate_spans(docs, items), tx.locate_spans(docs, items, most_bytes=0)
    assert got(one) == got(other) == [(1, 1, 7), (2, 2, 3), (3, 2, 1), (4, 1, 3), (5, 2, 1)]
    assert tx.locate_spans(docs, items.limit(0)).count() == 0
    assert got(tx.locate_spans(docs, spark.createDataFrame([(9, "")], "item_id long, text string"))) == [(9, 1, 1), (9, 2, 1), (9, 4, 1)]


def test_graph_hits_share_entities(spark):
    entities = spark.createDataFrame([(1, "email", "x"), (2, "email", "x"), (2, "phone", "5"), (1, "phone", "5"), (3, "phone", "5"), (4, "card", "5")], "doc_id long, kind string, entity string")
    seeds = spark.createDataFrame([(7, 1), (8, 4), (9, 99)], "query_id long, doc_id long")
    assert got(rt.graph_hits(seeds, entities, 2)) == [(7, 1, 1, 2.0), (7, 2, 2, 2.0), (8, 1, 4, 1.0)]


def test_questions_are_declined(spark):
    asked = spark.createDataFrame([(1, "Will it rain?"), (2, "Should I sell?"), (3, "who?")], "query_id long, text string")
    hits = spark.createDataFrame([(1, 9, 5.0), (2, 9, 50.0)], "query_id long, doc_id long, score double")
    assert got(rt.declined(asked, hits, 5.0)) == [(2, "out_of_scope"), (3, "no_evidence")]


def test_events_relations_and_times_from_text(spark):
    text = "user 7 purchased it on 2024-02-30, no: on 2024-02-28, 2024-02-28 at 10:11:12, in the week of 2024-02-26\nuser 8 logged in; a.b@c.de (123) 456-7890\nMIT License"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    from evigraph.operators import extraction as ex

    assert got(ex.extract_events(df)) == [(1, "login", 8), (1, "purchase", 7)]
    times = sorted((k, str(d), c) for _, k, d, c in ex.extract_times(df).collect())
    assert times == [("day", "2024-02-28", None), ("day", "None", None), ("instant", "2024-02-28", "10:11:12"), ("week", "2024-02-26", None)]
    assert got(ex.extract_relations(df)) == [(1, "reachable_at", "a.b@c.de", "(123) 456-7890")]


def test_pdf_round_trip():
    from evigraph.sources.pdf import pdf_text, write_pdf

    for text in ("", "one line", "ä (b) \\ c\n\nd", "\n".join(f"line {i}" for i in range(120)), "x\\101 \r y"):
        assert pdf_text(write_pdf(text)) == text
    assert pdf_text(None) is None and pdf_text(b"no") is None
    plain = b"%PDF-1.4\n4 0 obj\n<< /Length 9 >>\nstream\nBT [(a\\051) -20 <62>] TJ T* (c) ' ET\nendstream\nendobj"
    assert pdf_text(plain) == "a)b\n\nc"


def test_jdbc(spark, data, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    nation = src.load(spark, data, "nation")
    nation.write.format("jdbc").options(url=url, dbtable="nation").save()
    back = src.load_jdbc(spark, url, "nation", ("n_nationkey", 0, 25, 3))
    assert back.rdd.getNumPartitions() == 3
    assert got(back.select(*[F.col(c.upper()) for c in nation.columns])) == got(nation)


def test_bucketed_join_has_no_exchange(spark, data):
    plan = entry.queries()["j14_bucketed"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "hashpartitioning(l_orderkey" not in plan and "hashpartitioning(o_orderkey" not in plan


def test_repeated_query_ids_are_one(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])] * 9, "query_id long, q array<double>")
    assert got(rt.vector_topk(asked, vectors, 3)) == [(1, 1, 2, 0.707107)]
    assert got(rt.vector_range(asked, vectors, 0.8)) == []
