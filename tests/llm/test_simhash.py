import re

import numpy as np
import xxhash

from cases import awkward, empty, rows
from evigraph.llm import simhash
from evigraph.llm.graph import connected_components


def components(count, links):
    label = list(range(count))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(count)]


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lower)]


def brute_fingerprint(text, n=4):
    w = words_of(text)
    grams = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(docs, radius=4):
    fps = [brute_fingerprint(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    roots = components(len(docs), links)
    name = {}
    for (i, _), r in zip(docs, roots, strict=True):
        if i is not None:
            name[r] = min(name.get(r, i), i)
    return sorted(((i, f"{f:016x}", name.get(r)) for (i, _), f, r in zip(docs, fps, roots, strict=True)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_awkward(spark):
    assert result(simhash.near_duplicates(awkward(spark))) == brute([(r[0], r[1]) for r in rows()])
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_corpus(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(simhash.near_duplicates(df)) == brute(docs)


def test_large_groups_are_tiled(spark):
    """Many fingerprints that agree in most blocks, in tiles of eight."""
    rng = np.random.default_rng(3)
    base = [0x0F0F1234567890AB, 0x7777777777777777]
    fps = {b ^ sum(1 << int(x) for x in rng.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 3, 6) for _ in range(40)}
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(r.node, r.root) for r in connected_components(simhash.fingerprint_links(df, 4, tile_rows=8)).collect()}
    u = [f % 2**64 for f in fps]
    roots = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (u[i] ^ u[j]).bit_count() <= 4])
    sizes = {r: roots.count(r) for r in roots}
    assert got == {(fps[i], fps[r]) for i, r in enumerate(roots) if sizes[r] > 1}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (41, 50), (60, 60)]
    df = spark.createDataFrame(chain, "u long, v long")
    got = {(r.node, r.root) for r in connected_components(df).collect()}
    assert got == {(i, 0) for i in range(31)} | {(40, 40), (41, 40), (50, 40)}


def brute_similar(docs, n=5, similarity=0.8):
    sets = [{b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if (w := words_of(t)) else set() for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * max(1, len(sets[i] | sets[j])) or not sets[i] and not sets[j]]
    return components(len(docs), links)


def test_drop_similar(spark):
    base = [f"w{i}" for i in range(200)]
    edit = lambda *at: " ".join("zz" if i in at else w for i, w in enumerate(base))
    docs = [(1, edit()), (2, edit(7)), (3, edit(20, 60)), (4, edit(*range(0, 200, 9))), (5, "other text of a few words only"), (6, edit()), (7, " ".join(base[:170])), (8, None), (9, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    roots = brute_similar(docs)
    kept = sorted(r.doc_id for r in simhash.drop_similar(df).collect())
    assert kept == [docs[i][0] for i in range(len(docs)) if roots[i] == i] == [1, 4, 5, 8]


def test_drop_similar_awkward(spark):
    kept = simhash.drop_similar(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert kept.where("doc_id = 5").count() == 0 and kept.where("doc_id IS NULL").count() == 1
    assert simhash.drop_similar(empty(spark)).count() == 0


def test_verified_by_blocks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    a, b = np.triu_indices(30, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]
    assert simhash.verified(sets, a, b, 0.4, rows=7).tolist() == want
