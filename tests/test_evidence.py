"""Excerpts show what answers to the question."""

from evigraph.operators import retrieval as rt


def test_excerpts_hold_the_hit(spark):
    docs = [(1, "x " * 300 + "the Parliament voted on tariffs " + "y " * 300), (2, "nothing of the kind " * 20), (3, None), (4, "Tariffs at the head")]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in docs], "doc_id long, text string, source string")
    hits = spark.createDataFrame([(7, r, r, 1.0 / r, "lexical") for r in range(1, 5)] + [(8, 1, 1, 1.0, "vector")], "query_id long, rank long, doc_id long, score double, channel string")
    asked = spark.createDataFrame([(7, "Tariffs of parliament?"), (8, None)], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r for r in rt.evidence(hits, docs, 80, asked).collect()}
    assert len(got) == 5
    assert "Parliament" in got[7, 1].excerpt and len(got[7, 1].excerpt) == 80 and got[7, 1].start == 575
    assert got[7, 2].start == 1 and got[7, 3].excerpt is None and got[7, 4].excerpt.startswith("Tariffs")
    assert got[8, 1].excerpt == ("x " * 300)[:80]
    assert {r.start for r in rt.evidence(hits, docs).collect()} == {1}
