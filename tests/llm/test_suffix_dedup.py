import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import awkward, empty, rows
from evigraph.llm import suffix_dedup as sd


def brute(docs, length=50):
    """docs: (id or None, bytes). Result per row, in order of the rows."""
    last = 2**63 - 1
    first = {}
    for i, b in docs:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, last), last if i is None else i)
    out = []
    for i, b in docs:
        own, mask = last if i is None else i, bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < own:
                mask[s : s + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m)
        spans = sum(1 for j, m in enumerate(mask) if m and (j == 0 or not mask[j - 1]))
        out.append((i, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def same(df, docs, length=50):
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r)[:5] for r in df.collect()), key=order) == sorted(brute(docs, length), key=order)


def test_awkward(spark):
    docs = [(r[0], (r[1] or "").encode()) for r in rows()]
    same(sd.remove_repeats(awkward(spark)), docs)
    same(sd.remove_repeats(awkward(spark), batch_bytes=300), docs)
    assert sd.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("length", [20, 50])
def test_random_copies(spark, length):
    rng = random.Random(length)
    pool = ["".join(rng.choice("abcd ") for _ in range(rng.randint(30, 120))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(pool)[rng.randint(0, 20) :] for _ in range(rng.randint(0, 6)))) for i in range(150)]
    docs += [(150 + i, docs[i][1]) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    same(sd.remove_repeats(df, length, batch_bytes=2000), [(i, t.encode()) for i, t in docs], length)


def test_ids_that_repeat(spark):
    """A copy doesn't make another text of its id, or of no id, a copy."""
    a, b, c = "a copied text " * 5, "some other text " * 5, "yet another one " * 6
    docs = [(1, a), (5, a), (5, b), (None, a), (None, c), (None, c), (7, b)]
    same(sd.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")), [(i, t.encode()) for i, t in docs])


def test_kept_bytes(spark):
    df = spark.createDataFrame([(1, "x" * 60), (2, "a" + "x" * 60 + "b")], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in sd.remove_repeats(df).collect()} == {1: b"x" * 60, 2: b"ab"}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=40), min_size=1, max_size=12), st.integers(1, 3))
def test_radix_groups(items, columns):
    words = np.array([[hash((x, c)) % 3 for c in range(columns)] for x in items], np.uint64)
    group = np.array([len(x) % 2 for x in items])
    label = sd.radix_groups(words, group)
    for i in range(len(items)):
        for j in range(len(items)):
            assert (label[i] == label[j]) == (group[i] == group[j] and (words[i] == words[j]).all())


def test_pieces_do_not_matter():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    ends = np.array([700, 700, 1500, 3000])
    a, b = (sd.anchors_of(data, ends, 50, 25, piece) for piece in (1 << 19, 200))
    cover = lambda x: sorted((int(s), int(p)) for p, lo, hi in zip(x.at, x.low, x.high, strict=True) for s in range(lo, hi + 1))
    assert cover(a) == cover(b)
    starts = {s for s, _ in cover(a)}
    assert starts == {s for lo, hi in ((0, 700), (700, 1500), (1500, 3000)) for s in range(lo, hi - 49)}


def sent_by_anchor(n, per_batch=20):
    """Contexts and windows that batches send for documents with one common passage."""
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    docs = [(i, "".join(rng.choice("stuvwxyz ") for _ in range(120)) + passage + "".join(rng.choice("ijklmnop ") for _ in range(120))) for i in range(n)]
    tables = [pa.table({"doc_id": [i for i, _ in docs[a : a + per_batch]], "text": [t.encode() for _, t in docs[a : a + per_batch]]}) for a in range(0, n, per_batch)]
    batches = [sd.Batch(t, np.zeros(0, np.int64), 50) for t in tables]
    anchors = [sd.anchors_of(b.data, b.ends, 50, 25) for b in batches]
    asked = [np.unique(a.hash, return_counts=True) for a in anchors]
    replies = sd.match_fingerprints([sd._pack_fingerprints(h, c >= sd.HOT) for h, c in asked])
    contexts, windows = Counter(), Counter()
    for b, a, r in zip(batches, anchors, replies, strict=True):
        distinct, known, hot = sd._repeated(b, a, {0: r}, 1)
        contexts.update(sd.contexts_of(b, a, distinct, known & ~hot, 50, 25).hash.tolist())
        found = sd.windows_of(b, a, distinct, hot, 50)
        windows.update(zip(found.hash.tolist(), found.other.tolist(), strict=True))
    return max(contexts.values(), default=0), max(windows.values()), len(batches)


def test_a_common_passage_is_no_large_group():
    """No anchor's contexts grow with the documents; a window is sent once by a batch."""
    for n in (1000, 3000):
        contexts, windows, batches = sent_by_anchor(n)
        assert contexts <= sd.HOT**2 and windows == batches


def test_common_passages_and_near_copies(spark):
    """Hot anchors, by batches and within one, give the same result."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, other = word(130), word(400)
    docs = [(i, word(rng.randint(0, 60)) + passage[rng.randint(0, 5) :] + word(rng.randint(0, 60))) for i in range(200)]
    for i in range(200, 260):
        at = rng.randint(0, 390)
        docs.append((i, other[:at] + word(3) + other[at:]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = [(i, t.encode()) for i, t in docs]
    same(sd.remove_repeats(df, batch_bytes=1500), want)
    same(sd.remove_repeats(df, batch_bytes=1 << 20), want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.booleans()), max_size=70))
def test_packed_fingerprints(items):
    hashes, many = np.array([h for h, _ in items], np.uint64), np.array([m for _, m in items], bool)
    blob = sd._pack_fingerprints(hashes, many)
    bits = sd.match_fingerprints([blob])[0]
    hot = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(2, -1)[1] if items else np.zeros(0, np.uint8), count=len(items))
    low = hashes & np.uint64(2**40 - 1)
    size = {x: (low == x).sum() for x in low.tolist()}
    assert hot.tolist() == [int(many[low == x].any() or size[x] >= sd.HOT) for x in low.tolist()]


def test_reducers_work_in_ranges(monkeypatch):
    """What a reducer answers doesn't depend on how much it takes at a time."""
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcd ") for _ in range(90)) for _ in range(20)]
    docs = [(i, "".join(rng.choices(pool, k=4)).encode()) for i in range(120)]
    contexts, windows = [], []
    for a in range(0, 120, 30):
        table = pa.table({"doc_id": [i for i, _ in docs[a : a + 30]], "text": [t for _, t in docs[a : a + 30]]})
        batch = sd.Batch(table, np.zeros(0, np.int64), 50)
        anchors = sd.anchors_of(batch.data, batch.ends, 50, 25)
        distinct = np.unique(anchors.hash)
        found = sd.contexts_of(batch, anchors, distinct, np.ones(len(distinct), bool), 50, 25)
        contexts.append(sd._pack_contexts(batch, anchors, found, 0, len(found.hash), 50))
        all_ = sd.windows_of(batch, anchors, distinct, np.ones(len(distinct), bool), 50)
        windows.append(sd._pack_windows(all_, 0, len(all_.hash)))
    whole = sd.smallest_ids(contexts, 50), sd.smallest_of_windows(windows)
    monkeypatch.setattr(sd, "AT_ONCE", 16)
    assert (sd.smallest_ids(contexts, 50), sd.smallest_of_windows(windows)) == whole
    assert any(np.frombuffer(r, np.int64, 1)[0] for r in whole[0]) and any(np.frombuffer(r, np.int64, 1)[0] for r in whole[1])


def test_reducers_get_equal_shares():
    """Anchors are least hashes of their windows; their numbers must not crowd at the low end."""
    data = np.random.default_rng(2).integers(97, 123, 200000).astype(np.uint8)
    anchors = sd.anchors_of(data, np.array([len(data)]), 50, 25)
    share = np.bincount(sd._part_of(anchors.hash, 10), minlength=10) / len(anchors.hash)
    assert share.max() < 0.12 and share.min() > 0.08


FAR = [-(2**63), -(2**63) + 1, -5, 0, 3, 7, 2**32, 2**62, 2**63 - 2, None]


@given(st.lists(st.integers(-(2**63), 2**63 - 2), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_packed_ids_are_read_back(ids):
    ids = np.array([*ids, 2**63 - 1])
    head, near = sd._pack_ids(ids)
    base, width = (int(x) for x in np.frombuffer(head, np.int64))
    assert sd._unpack_ids(near, 0, len(ids), base, width).tolist() == ids.tolist()


@pytest.mark.parametrize("copies", [1, 60])
def test_ids_that_are_far_apart(spark, copies):
    """Negative and null ids in one piece; with many copies anchors are hot."""
    rng = random.Random(copies)
    own = {i: "".join(rng.choice("abcdefgh ") for _ in range(200)) for i in FAR}
    shared = "".join(rng.choice("xyz ") for _ in range(200))
    docs = [(i, own[i] + (shared if i in (None, 3, 2**62) else "")) for i in FAR]
    docs += [(1000 + i, f"{i} " + shared) for i in range(copies)]
    docs += [(-(2**63), own[-(2**63)] + own[7]), (None, own[None] + own[2**62])]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    same(sd.remove_repeats(df), [(i, t.encode()) for i, t in docs])
    same(sd.remove_repeats(df, batch_bytes=500), [(i, t.encode()) for i, t in docs])


def test_no_text_goes_that_no_smaller_document_has(spark):
    """Null and 3 share a passage; -5 has none of it."""
    rng = random.Random(1)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(3))
    got = {r.doc_id: r.n_removed for r in sd.remove_repeats(spark.createDataFrame([(-5, b), (7, c), (None, a), (3, a)], "doc_id long, text string").coalesce(1)).collect()}
    assert got == {-5: 0, 7: 0, None: 200, 3: 0}
