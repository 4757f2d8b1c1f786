"""Similar short texts, of whose fingerprints some differ beyond the radius."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from evigraph.llm import simhash


def texts(pairs, words):
    """Texts of ``words`` words and of all but the last; 5 and 4 shingles of 9 words have a similarity of 0.8."""
    full = [[f"w{p}x{i}" for i in range(words)] for p in range(pairs)]
    return [(p, " ".join(w)) for p, w in enumerate(full)] + [(pairs + p, " ".join(w[:-1])) for p, w in enumerate(full)]


def missed(docs, pairs):
    sets = [simhash.shingle_set(t, 5) for _, t in docs]
    fp = np.array([[simhash.fingerprint(s), simhash.fingerprint(simhash.second_hash(s))] for s in sets], np.uint64)
    bits = np.bitwise_count(fp[:pairs] ^ fp[pairs:]).astype(int)
    return int(((bits[:, 0] > simhash.WORD_RADIUS) | (bits.sum(axis=1) > simhash.BOTH_RADIUS)).sum())


def test_no_short_pair_is_lost(spark):
    docs = texts(400, 9)
    assert missed(docs, 400) > 0
    kept = simhash.drop_similar(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(400))


def test_links_by_exact_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, 25).astype(np.uint64)) for _ in range(40)]
    similar = lambda i, j, s: len(np.intersect1d(sets[i], sets[j])) >= s * len(np.union1d(sets[i], sets[j]))
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if similar(i, j, 0.4)}
    assert {(int(i), int(j)) for i, j in zip(*simhash.set_links(sets, 0.4), strict=True)} == want
    assert all(np.intersect1d(simhash.set_prefix(sets[i], 0.4), simhash.set_prefix(sets[j], 0.4)).size for i, j in want)


def labels(n, pairs):
    a, b = np.array(sorted(pairs) or [(0, 0)]).T
    return simhash.lowest_label(n, a, b)


def test_forest_of_sets():
    """Within a tile and between two, against all pairs."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(120)]
    like = {(i, j) for i in range(120) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j]))}
    assert (simhash.set_forest(sets, np.ones(120, bool), 0.4) == labels(120, like)).all()
    first = rng.random(120) < 0.5
    assert (simhash.set_forest(sets, first, 0.4) == labels(120, {(i, j) for i, j in like if first[i] != first[j]})).all()


def test_a_large_cluster_of_short_texts_needs_no_room_for_its_pairs():
    base = np.arange(60).astype(np.uint64)
    sets = [np.unique(np.r_[np.delete(base, i % 60), np.uint64(1000 + i)]) for i in range(4000)]
    tracemalloc.start()
    label = simhash.set_forest(sets, np.ones(4000, bool), 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (label == 0).all() and peak < 64 << 20  # all pairs are 16 million


def test_rare_shingles_come_first():
    """Of a passage that all texts have, only texts that hold little else keep a shingle in their prefix."""
    passage = np.arange(10, dtype=np.uint64)
    sets = [np.unique(np.r_[passage, np.arange(1000 * i, 1000 * i + 40, dtype=np.uint64) + np.uint64(100)]) for i in range(1, 31)]
    seen = np.bincount(np.concatenate(sets).astype(np.int64) & (simhash.SLOTS - 1), minlength=simhash.SLOTS)
    assert any(np.intersect1d(simhash.set_prefix(x, 0.8), passage).size for x in sets)
    assert not any(np.intersect1d(simhash.set_prefix(x, 0.8, seen), passage).size for x in sets)


def test_tiles_lose_no_link(spark):
    """Clusters that share shingles with many more texts than a tile holds."""
    rng = np.random.default_rng(6)
    docs = []
    for i in range(300):
        w = [f"c{i % 3}w{k}" for k in range(40)]
        for k in rng.integers(0, 40, int(rng.integers(0, 3))):
            w[k] = f"e{int(rng.integers(0, 50))}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = simhash.keyed(df, "doc_id", "text")
    own = simhash.as_table(simhash._set_rows(rows, 5))
    kinds = own.groupBy(*simhash.SET).agg(F.min(F.struct(*simhash.KEY)).alias("first"), F.min("n").alias("n"))
    kinds = simhash.as_table(kinds.withColumn("class", F.col("first.kd")))
    sets = {r["class"]: simhash.shingle_set(docs[r["class"]][1], 5) for r in kinds.select("class").collect()}
    ids = sorted(sets)
    want = simhash.lowest_label(len(ids), *simhash.set_links([sets[i] for i in ids], 0.8))
    for tile_rows in (8, 1024):
        links = [tuple(r) for r in simhash.small_links(rows, kinds, 5, 0.8, tile_rows).collect()]
        assert (labels(len(ids), {(ids.index(u), ids.index(v)) for u, v in links}) == want).all()
        assert len(links) < 40 * len(ids)
    assert len(set(want)) < len(ids)


def bits_miss(shared, own, pairs, seed=0):
    """How many pairs of sets, with so many shingles in common and of their own, the bits don't propose."""
    rng = np.random.default_rng(seed)
    lost = 0
    for _ in range(pairs):
        h = rng.integers(0, 2**63, shared + 2 * own, dtype=np.int64).view(np.uint64) ^ rng.integers(0, 2**63, shared + 2 * own, dtype=np.int64).view(np.uint64) << np.uint64(1)
        a, b = h[: shared + own], np.r_[h[:shared], h[shared + own :]]
        bits = [(simhash.fingerprint(f(a)) ^ simhash.fingerprint(f(b))).bit_count() for f in (lambda x: x, simhash.second_hash)]
        lost += bits[0] > simhash.WORD_RADIUS or sum(bits) > simhash.BOTH_RADIUS
    return lost


def test_recall_of_long_texts_at_the_threshold():
    """A similarity of exactly 0.8 (8 parts shared of 10), in texts too long for the exact join."""
    for shared, own in ((64, 8), (320, 40), (1600, 200)):
        assert shared / (shared + 2 * own) == 0.8
        assert bits_miss(shared, own, 1500) <= 0.01 * 1500


def cluster(n, size=120, seed=1):
    """A group as in a task: near copies of one set, in one tile."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**62, size).astype(np.uint64)
    sets = []
    for _ in range(n):
        own = base.copy()
        own[rng.integers(0, size, 3)] = rng.integers(0, 2**62, 3).astype(np.uint64)
        sets.append(np.unique(own))
    fps = np.array([[simhash.fingerprint(s), simhash.fingerprint(simhash.second_hash(s))] for s in sets], np.uint64)
    order = np.argsort(np.bitwise_count(fps[:, 0]), kind="stable")
    zero = np.zeros(n, np.int32)
    group = {"a1": zero, "a2": zero, "b1": zero, "b2": zero, "first": np.ones(n, bool), "n": np.array([len(sets[i]) for i in order], np.int32)}
    group |= {"fp": fps[order, 0].view(np.int64), "fp2": fps[order, 1].view(np.int64), "class": order.astype(np.int64)}
    return group | {"shingles": np.array([sets[i].tobytes() for i in order], object)}


def test_a_large_cluster_needs_no_room_for_its_pairs():
    peaks = []
    for n in (1500, 6000):
        group = cluster(n)
        tracemalloc.start()
        label = simhash.similar_forest(group, 0.8)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert (label == 0).all()
    assert peaks[1] < 200 << 20 and peaks[1] < 4 * peaks[0] + (16 << 20)  # all pairs would be 16 times as much


def test_forest_is_that_of_all_similar_pairs():
    rng = np.random.default_rng(4)
    group = cluster(700, size=40, seed=7)
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
    keep = rng.random(700) < 0.5  # some sets of their own
    for i in np.flatnonzero(keep):
        sets[i] = np.unique(np.r_[sets[i][: int(rng.integers(10, 30))], rng.integers(0, 2**62, 15).astype(np.uint64)])
    group["shingles"] = np.array([s.tobytes() for s in sets], object)
    group["n"] = np.array([len(s) for s in sets], np.int32)
    group["fp"] = group["fp2"] = np.zeros(700, np.int64)  # bits propose all pairs
    want = simhash.lowest_label(700, *simhash.set_links(sets, 0.8))
    assert (simhash.similar_forest(group, 0.8) == want).all()
