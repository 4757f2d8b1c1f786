"""Queries over every row they are asked for, against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from evigraph.operators.seams import HashingEmbedder
from evigraph.plans import PLANS, runner
from evigraph.plans import retrieval as plans
from evigraph.sources.tables import Tables
from oracle import plain


def rows(spark, folder, name, *columns):
    return [tuple(plain(r[c]) for c in columns) for r in runner(PLANS[name])(spark, str(folder)).collect()]


@pytest.fixture(scope="module")
def asked(spark, tmp_path_factory):
    """Twelve questions with ids up to 90; each but the last stands in one document
    or two. Some documents share an address, and half of the ids have a vector."""
    folder = tmp_path_factory.mktemp("asked")
    items = [(8 * i + 2, f"alpha{i} beta{i % 3} gamma delta{i % 5} end{i} of it") for i in range(12)]
    mail = lambda i: f"\nwrite to box{i % 4}@mail.example.com" if i % 2 else ""
    docs = [(i, f"Head of text {i}. " + "filler words " * (i % 4 * 20) + x + ". Tail common gamma." + mail(i), "en", "s", 0) for i, (_, x) in enumerate(items[:-1])]
    docs += [(20 + i, f"Other. {items[i][1]} again" + mail(i), "en", "s", 0) for i in (0, 7)]
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=4)], 0) for i in (*range(0, 12), 27, 42, 58, 74, 90)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder, items, docs, vectors


def brute_bm25(items, docs):
    words = {d[0]: re.findall(r"\w+", d[1].lower()) for d in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for q, text in items:
        for d, ws in words.items():
            tf = Counter(ws)
            parts = [math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(re.findall(r"\w+", text.lower())) if tf[w]]
            if parts:
                out[q, d] = sum(parts)
    return out


def top10(scores):
    """Ranked documents of each question from {(question, document): score}."""
    out = {}
    for (q, d), _ in sorted(scores.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        out.setdefault(q, []).append(d)
    return {q: ds[:10] for q, ds in out.items()}


def brute_channels(asked):
    """The three channels and the gold, each from its definition."""
    _, items, docs, vectors = asked
    lexical = top10({k: round(s, 6) for k, s in brute_bm25(items, docs).items()})
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v, _ in vectors}
    known = {d[0] for d in docs}
    vector = top10({(q, d): round(float(unit[q] @ unit[d]), 6) for q, _ in items if q in unit for d in unit if d in known and d != q})
    mails = {d[0]: set(re.findall(r"\S+@\S+\.com", d[1])) for d in docs}
    shared = {}
    for q, _ in items:
        own = set().union(*[mails[d] for d in lexical.get(q, [])[:3]])
        shared |= {(q, d): len(own & m) for d, m in mails.items() if own & m}
    gold = {q: {d[0] for d in docs if text in d[1]} for q, text in items}
    return {"lexical": lexical, "vector": vector, "graph": top10(shared)}, {q: g for q, g in gold.items() if g}


def brute_fused(channels, names):
    score = Counter()
    for name in names:
        for q, found in channels[name].items():
            for rank, d in enumerate(found, 1):
                score[q, d] += 1 / (60 + rank)
    return top10({k: round(s, 9) for k, s in score.items()})


def test_every_question_is_asked(spark, asked):
    folder, items, docs, _ = asked
    want = brute_bm25(items, docs)
    got = {(q, d): s for q, d, s in rows(spark, folder, "f07_bm25", "query_id", "doc_id", "score")}
    channels, gold = brute_channels(asked)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    assert channels["graph"] and channels["vector"]
    fused = {c: brute_fused(channels, names) for c, names in plans.CONFIGS.items()}
    listed = lambda f: sorted((q, r, d) for q, ds in f.items() for r, d in enumerate(ds, 1))
    assert sorted(rows(spark, folder, "f01_fuse", "query_id", "rank", "doc_id")) == listed(fused["D"])
    assert sorted(rows(spark, folder, "f03_evidence", "query_id", "rank", "doc_id")) == listed(fused["E"])
    configs = sorted((c, *x) for c, f in fused.items() for x in listed(f))
    assert sorted(rows(spark, folder, "f02_configs", "config", "query_id", "rank", "doc_id")) == configs
    assert len(plans.CONFIGS) == 6
    assert {q for q, *_ in rows(spark, folder, "f05_trace", "query_id", "doc_id")} == {q for q, _ in items}
    assert sorted(rows(spark, folder, "f04_answers", "query_id", "doc_id")) == [(q, f[0]) for q, f in sorted(fused["E"].items())]
    assert {q for (q,) in rows(spark, folder, "g07_review", "query_id")} == {q for q, _ in items}
    ranked = channels["lexical"]
    recall = {q: len(g & set(ranked[q])) / len(g) for q, g in gold.items()}
    assert dict(rows(spark, folder, "g01_evidence_recall", "query_id", "recall")) == {q: round(x, 6) for q, x in recall.items()}
    core = [recall[q] for q, g in gold.items() if len(g) == 1]  # evidence in one document
    assert rows(spark, folder, "g02_core_subset", "n_queries", "mean_recall") == [(len(core), round(sum(core) / len(core), 6) if core else None)]
    rr = [max((1 / r for r, d in enumerate(ranked[q], 1) if d in g), default=0) for q, g in gold.items()]
    assert rows(spark, folder, "g08_rank_metrics", "n_queries", "mrr") == [(len(gold), round(sum(rr) / len(gold), 6))]
    value = lambda f, q, g: 2 if f.get(q, [None])[0] in g else 1 if g & set(f.get(q, [])) else 0
    scores = {c: round(sum(value(fused[c], q, g) for q, g in gold.items()) / len(gold), 6) for c in "ACE"}
    assert dict(rows(spark, folder, "g04_qa_score", "metric", "value")) == scores
    found = {c: [len(g & set(fused[c].get(q, []))) / len(g) for q, g in gold.items()] for c in "ACE"}
    compared = {m: xs for m, *xs in rows(spark, folder, "g05_compare", "metric", "A", "C", "E")}
    assert compared["recall"] == [round(sum(round(x, 6) for x in found[c]) / len(gold), 6) for c in "ACE"]
    assert compared["complete"] == [round(sum(x == 1 for x in found[c]) / len(gold), 6) for c in "ACE"]


def test_every_fiftieth_vector_asks_all(spark, data):
    stored = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in stored]), np.array([r[1] for r in stored], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    top, near, fifth = set(), set(), set()
    for q in np.flatnonzero(ids % 50 == 0):
        score = np.round(x @ x[q], 6)
        near |= {(int(ids[q]), int(v)) for v in ids[(score >= 0.3) & (ids != ids[q])]}
        order = [v for v in np.lexsort((ids, -score)) if v != q][:5]
        top |= {(int(ids[q]), int(ids[v])) for v in order}
    for q in np.flatnonzero(ids % 5 == 0):
        fifth |= {(int(ids[q]), int(ids[v])) for v in [v for v in np.lexsort((ids, -np.round(x @ x[q], 6))) if v != q][:5]}
    assert {q for q, _ in top} == {int(i) for i in ids if i % 50 == 0}
    found = lambda name: set(rows(spark, data, name, "query_id", "vec_id"))
    assert found("d03_vector_topk") == top and found("d05_vector_topk_batch") == fifth
    assert found("d04_vector_range") == near
    assert len(found("d06_vector_ann") & top) >= 0.9 * len(top)


def test_every_chunk_is_embedded(spark, data):
    embed = HashingEmbedder().embed
    want = {(r.doc_id, i): embed(r.text[i * 450 : i * 450 + 500]) for r in spark.read.parquet(f"{data}/documents.parquet").collect() for i in range(max(1, math.ceil((len(r.text) - 50) / 450)))}
    got = runner(PLANS["d01_embed"])(spark, data).collect()
    assert len(got) == len(want) and {(r.doc_id, r.chunk_no): r.embedding for r in got} == want
    assert max(i for _, i in want) > 0


def test_prompts_hold_whole_texts(spark, asked):
    class Echo:
        def complete(self, prompt: str) -> str:
            return prompt

    folder, items, docs, _ = asked
    texts = {d[0]: d[1] for d in docs}
    assert any(items[3][1] in t and items[3][1] not in t[:400] for t in texts.values())
    answers = {r.query_id: r for r in plans._answered(Tables(spark, str(folder)), Echo()).collect()}
    reviews = {r.query_id: r.review for r in plans._reviewed(Tables(spark, str(folder)), Echo()).collect()}
    assert answers.keys() == reviews.keys() == {q for q, _ in items}
    for q, r in answers.items():
        assert r.answer == f"QUESTION:\n{q}\nEVIDENCE:\n{texts[r.doc_id]}"
        assert reviews[q].endswith(f"\nEVIDENCE:\n{texts[r.doc_id]}")
    held = [q for q, text in items[:-1] if text in answers[q].answer]
    assert held == [q for q, text in items[:-1] if text in texts[answers[q].doc_id]] and held
