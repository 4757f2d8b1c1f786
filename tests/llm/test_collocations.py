"""Collocations against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from cases import awkward, empty
from evigraph.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def by_hand(docs, least, longest, top, within):
    f, total = Counter(), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            f.update((lang or "und", *words[i : i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = defaultdict(int)
    for p, a in candidates.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                inside[(p[0], *p[i : i + m])] = max(inside[(p[0], *p[i : i + m])], a)
    found = defaultdict(list)
    for p, a in candidates.items():
        if 100 * inside[p] >= within * a and inside[p]:
            continue
        cuts = [(2_000_000 * a // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
        score, _, left, right = min(cuts)
        found[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, le, ri, total[lang], -score) for lang, rows in found.items() for rank, (score, a, p, le, ri) in enumerate(sorted(rows)[:top], 1))


def corpus():
    random.seed(5)
    words = ["a", "B", "the", "über", "x\x1fy", "日本", "é", "d-e", "q'"]
    docs = []
    for i in range(120):
        text = "".join(random.choices(words, [9, 8, 7, 3, 2, 2, 2, 1, 1])[0] + random.choice([" ", " ", " ", " ", "\t", ". ", ",", "\n", "  "]) for _ in range(random.randint(0, 60)))
        docs.append((text, random.choice(["en", "de", None])))
    docs += [("New  York\tCity hall is new york city hall", "en")] * 20 + [("a a a a a a a", "de")] * 3 + [(None, "en"), ("", None), (" . , ", "fr"), ("one", "es")]
    return docs + [("the end " * 400, "en")]


@pytest.mark.parametrize("shard_words,least,longest,top", [(50, 5, 4, 30), (1 << 20, 12, 3, 5), (200, 1, 4, 500), (300, 4, 6, 100)])
def test_same_by_hand(spark, shard_words, least, longest, top):
    df = spark.createDataFrame(corpus(), "text string, lang string").repartition(3)
    got = co.collocations(df, least, longest, top, shard_words=shard_words).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == by_hand(corpus(), least, longest, top, 80)


def test_full_bit_arrays_change_nothing(spark, monkeypatch):
    """A bit array in which every bit is set keeps nothing out."""
    df = spark.createDataFrame(corpus(), "text string, lang string")
    monkeypatch.setattr(co, "LEAST_BITS", 3)
    monkeypatch.setattr(co, "GROUP_BLOCKS", 4)
    got = co.collocations(df, 3, shard_words=100, most_bits=3).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == by_hand(corpus(), 3, 4, 2000, 80)


def test_bitmaps_hold_the_positions():
    codes = np.array([0, 1, -1, 0, 0, 2] * 9 + [1])
    pointers, blocks, bits = co.position_bitmaps(codes)
    for code in range(3):
        at = slice(pointers[code], pointers[code + 1])
        held = [b * co.BLOCK + i for b, x in zip(blocks[at].tolist(), bits[at].tolist(), strict=True) for i in range(co.BLOCK) if x >> i & 1]
        assert held == np.flatnonzero(codes == code).tolist()


def test_counts_that_pass_64_bits(spark):
    """Scores are computed in decimals."""
    one = spark.sql(f"SELECT cast({co.SCALE} AS decimal(8,0)) * cast(9000000000000000000 AS decimal(19,0)) div cast(9000000000000000000 + 0 AS decimal(20,0)) AS s")
    assert one.first().s == co.SCALE


def test_awkward(spark):
    docs = [(r.text, r.lang) for r in awkward(spark).collect()]
    got = co.collocations(awkward(spark), 2).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == by_hand(docs, 2, 4, 2000, 80)
    assert co.collocations(empty(spark)).count() == 0
    assert co.collocations(awkward(spark), 10**6).count() == 0


def test_many_pieces_and_packs_change_nothing(spark, monkeypatch):
    """Counts are cut into pieces and flushed after every shard."""
    monkeypatch.setattr(co, "MERGED_ROWS", 40)
    monkeypatch.setattr(co, "PIECE_WORDS", 90)
    df = spark.createDataFrame(corpus(), "text string, lang string").repartition(3)
    got = co.collocations(df, 4, shard_words=200).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == by_hand(corpus(), 4, 4, 2000, 80)


def test_packed_counts_are_small_and_whole():
    """Pairs of several shards are shipped in under three bytes each, and none is lost."""
    rng = np.random.default_rng(4)
    known = rng.integers(0, (1 << 64) - 1, 60_000, np.uint64)
    rows = [(rng.choice(known, 50_000, replace=False), rng.integers(1, 9, 50_000)) for _ in range(4)]
    batches = list(co._packed(iter(rows), 32, 7))
    n = sum(b["n"].to_numpy().sum() for b in batches)
    assert sum(b["keys"].nbytes + b["counts"].nbytes for b in batches) < 3 * n
    want = Counter()
    for hashes, counts in rows:
        for h, c in zip((hashes >> np.uint64(32)).tolist(), counts.tolist(), strict=True):
            want[h] += c
    table = pa.Table.from_batches(batches)
    got = [h for i in range(7) for h in co._often(20)(table.filter(pc.equal(table["piece"], i)))["h"].to_pylist()]
    assert got == sorted(h for h, c in want.items() if c >= 20)
