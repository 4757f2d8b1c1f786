"""The inverted index against full scores."""

import random

import pytest

from evigraph.operators import bounds
from evigraph.operators import postings as po
from evigraph.operators import retrieval as rt


def corpus(spark, n=400):
    """A common word everywhere, rare words in few documents."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, "all " * rng.randint(1, 3) + " ".join(rng.choices(words, k=rng.randint(1, 40))) + (f" rare{i % 50}" if i % 3 == 0 else "")) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "all " * 500), (n + 3, "same text w1"), (n + 4, "same text w1"), (None, "w1 rare3")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


def full(docs, queries, k):
    return sorted(tuple(r) for r in rt.bm25(queries, docs.where("doc_id IS NOT NULL"), k).collect())


@pytest.mark.parametrize("range_docs,group_ranges", [(1, 3), (16, 1), (4096, 128)])
def test_same_as_full_scores(spark, range_docs, group_ranges):
    docs = corpus(spark)
    asked = [(1, "rare3 rare9"), (2, "all w1 w2 rare0"), (3, "ALL"), (4, "same text"), (5, "unknown"), (6, ""), (7, None), (8, "w3 w3 w4 w5 w6")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    want = full(docs, queries, 7)
    for only in (None, queries):
        index = po.build(docs, range_docs=range_docs, asked=only)
        assert sorted(tuple(r) for r in po.search(index, queries, 7, group_ranges=group_ranges).collect()) == want
    assert max(r[1] for r in want) == 7 and not [r for r in want if r[0] in (5, 6, 7)]


def test_blocks_are_left_out(spark):
    """A rare word decides: of the common word's postings few are scored."""
    docs = corpus(spark, 3000)
    queries = spark.createDataFrame([(1, "rare3 all")], "query_id long, text string")
    read = {}
    got = po.search(po.build(docs, range_docs=4), queries, 5, read=read).collect()
    assert sorted(tuple(r) for r in got) == full(docs, queries, 5)
    assert read["all"] > 3000 and read["scored"] < read["all"] / 5


def test_blocks_of_queries(spark, monkeypatch):
    docs = corpus(spark)
    queries = spark.createDataFrame([(i, f"w{i} all rare{i}") for i in range(12)], "query_id long, text string")
    want = full(docs, queries, 4)
    monkeypatch.setattr(po, "MAX_TERMS", 9)
    assert sorted(tuple(r) for r in po.search(po.build(docs), queries, 4).collect()) == want


def test_a_hot_term_is_many_blocks(spark):
    index = po.build(corpus(spark), range_docs=16)
    sizes = [len(r.docs) for r in index.blocks.where("term = 'all'").collect()]
    assert sum(sizes) == 401 and len(sizes) > 15 and max(sizes) < 60


def test_saved_and_loaded(spark, tmp_path):
    docs, queries = corpus(spark), spark.createDataFrame([(1, "w1 rare0 all")], "query_id long, text string")
    index = po.build(docs)
    po.save(index, str(tmp_path / "index"))
    loaded = po.load(spark, str(tmp_path / "index"))
    assert (loaded.n_docs, loaded.mean_len) == (index.n_docs, index.mean_len)
    assert po.search(loaded, queries, 3).collect() == po.search(index, queries, 3).collect()


def test_nothing_to_search(spark):
    queries = spark.createDataFrame([(1, "w1")], "query_id long, text string")
    assert po.search(po.build(corpus(spark).limit(0)), queries, 3).count() == 0
    assert po.search(po.build(corpus(spark)), queries.limit(0), 3).count() == 0


def test_texts_are_dealt_and_not_their_terms(spark, monkeypatch):
    """What a task deals to others is texts; a group of ranges is a task of its own."""
    plans, stored = [], po.as_table
    monkeypatch.setattr(po, "as_table", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df))[1])
    docs, queries = corpus(spark), spark.createDataFrame([(1, "w1 rare0 all"), (2, None)], "query_id long, text string")
    for only in (None, queries):
        plans.clear()
        index = po.build(docs, range_docs=4, asked=only)
        assert "explode" in plans[0] and plans[0].index("explode") < plans[0].index("REPARTITION_BY_NUM")
    plans.clear()
    po.search(index, queries, 3, group_ranges=2)
    assert "shufflepartitionidpassthrough" in plans[-1].lower() and "hashpartitioning(group" not in plans[-1]


def test_more_terms_than_are_broadcast(spark, monkeypatch):
    docs, queries = corpus(spark), spark.createDataFrame([(1, "w1 rare0 all"), (2, "w2")], "query_id long, text string")
    want = full(docs, queries, 4)
    monkeypatch.setattr(po, "MAX_TERMS", 2)
    index = po.build(docs, range_docs=16, asked=queries)
    assert {r.term for r in index.terms.collect()} == {"w1", "rare0", "all", "w2"}
    assert sorted(tuple(r) for r in po.search(index, queries, 4).collect()) == want


def test_tasks_have_equal_ranges(spark, monkeypatch):
    """Ranges are dealt by number, so no task groups more of them than its share."""
    queries, found, stored = spark.createDataFrame([(1, "all")], "query_id long, text string"), [], po.as_table
    held = lambda rows: iter([(len({r.part for r in rows}),)])
    monkeypatch.setattr(po, "as_table", lambda df: (found.extend(n for (n,) in df.rdd.mapPartitions(held).collect()) if "part" in df.columns else None, stored(df))[1])
    monkeypatch.setattr(bounds, "TASK_DOCS", 64)
    po.build(corpus(spark, 2000), range_docs=8, asked=queries)
    assert len(found) == 32 and sum(found) == 251 and max(found) == 8
