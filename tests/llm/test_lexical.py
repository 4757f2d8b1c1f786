"""Lexical search against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cases import awkward, empty
from evigraph.llm import lexical_search as ls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
terms = lambda text: re.findall(ls.TERM, (text or "").translate(LOWER))


def by_hand(docs, queries, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in queries:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for ident, c in counted:
            norm = 100 - 50 + 50 * sum(c.values()) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * norm)) for t in wanted if c[t])
            if score > 0:
                scores.append((-score, ident is None, ident))
        ranked = sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        out += [(item, rank, ident, -score) for rank, (score, _, ident) in enumerate(ranked, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_docs,block_terms", [(7, 3), (1000, 1 << 17)])
def test_same_by_hand(spark, shard_docs, block_terms):
    random.seed(3)
    words = ["Über", "naïve", "a1", "B2", "c", "d-e", "x_y", "日本", "\U0001f600z"] + [f"w{i}" for i in range(15)]
    docs = [(random.choice([i, i // 2, -i]), " ".join(random.choices(words, k=random.randint(0, 12)))) for i in range(150)]
    docs += [(1000 + i, "same text w1") for i in range(40)] + [(None, "w1 w2"), (None, "w1 w2"), (7, None), (8, ""), (9, " .,;"), (2**62, "w3 c"), (-(2**62), "w3 c")]
    queries = [(i, " ".join(random.choices(words, k=4))) for i in range(12)] + [(3, "w1 W1 same"), (50, None), (51, "nothingness"), (None, "w1"), (52, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ls.search(ls.build_index(df, shard_docs=shard_docs), spark.createDataFrame(queries, "item_id long, text string"), 5, block_terms=block_terms)
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(docs, queries, 5)


def test_ties_with_the_last_go_to_the_smaller_id():
    score, ids = np.array([5, 9, 5, 5, 1, 5]), np.array([40, 3, 10, 30, 1, 20])
    assert ids[ls.best_first(score, ids, 3)].tolist() == [3, 10, 20]
    assert ids[ls.best_first(score, ids, 10)].tolist() == [3, 10, 20, 30, 40, 1]


def test_an_index_has_every_row(spark):
    index = ls.build_index(awkward(spark), shard_docs=4)
    ids = [i for r in index.shards.collect() for i in r.ids]
    assert sorted(ids, key=str) == sorted((r.doc_id for r in awkward(spark).collect()), key=str)
    assert index.n_terms > 30000


def test_awkward(spark):
    queries = awkward(spark).withColumnRenamed("doc_id", "item_id")
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    got = ls.search(ls.build_index(awkward(spark), shard_bytes=100), queries, 4).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_hand(rows, rows, 4)
    assert ls.search(ls.build_index(empty(spark)), queries).count() == 0
    assert ls.search(ls.build_index(awkward(spark)), empty(spark).withColumnRenamed("doc_id", "item_id")).count() == 0
