"""The stages one after the other, each written and read, and each on its own."""

import pytest

import corpus_pipeline as cp
from cases import LINE, OTHER
from evigraph.llm import line_dedup, toxicity


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = {"documents": docs}
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, data).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_columns(stages):
    for name, _ in cp.STAGES[:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes


def test_toxic_documents_go(spark, data, stages):
    docs = stages["documents"]
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    assert {r.doc_id for r in stages["toxicity"].collect()} == {i for i, p in scores.items() if not p}


def test_lines(stages):
    want = {r.doc_id: r.text for r in line_dedup.dedup_lines(stages["toxicity"]).collect()}
    got = {r.doc_id: (r.text, r.n_chars) for r in stages["line_dedup"].collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_near_duplicates(stages):
    from test_simhash import brute_similar

    docs = sorted((r.doc_id, r.text) for r in stages["line_dedup"].collect())
    roots = brute_similar(docs)
    assert sorted(r.doc_id for r in stages["simhash_near_dedup"].collect()) == [docs[i][0] for i, r in enumerate(roots) if r == i]


def test_mixing_and_packing(stages):
    sampled = {r.doc_id: r.text for r in stages["mixing"].collect()}
    before = {r.doc_id: r.text for r in stages["simhash_near_dedup"].collect()}
    assert 0 < len(sampled) < len(before) and all(before[i] == t for i, t in sampled.items())
    tokens = {}
    for r in stages["packing"].collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert tokens == {i: len(t.encode().split()) for i, t in sampled.items()}


def test_run(spark, data, stages):
    assert sorted(map(tuple, cp.run(spark, data).collect())) == sorted(map(tuple, stages["packing"].collect()))


def test_odd_rows(spark, data, tmp_path):
    rows = [(1, f"{LINE}\n{OTHER}", "en", "src0", 9), (None, None, None, None, None), (2, "", "en", "src1", 0), (3, f"{LINE}\n{OTHER}", "de", None, 9), (3, f"{LINE}\n{OTHER}", "de", None, 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for start in (rows, []):
        docs = spark.createDataFrame(start, schema)
        for n, (_, stage) in enumerate(cp.STAGES):
            path = str(tmp_path / f"{len(start)}-{n}")
            stage(spark, docs, data).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() <= 4
