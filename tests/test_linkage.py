"""Record linkage: planted rates, planted variants and awkward records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.operators import linkage as ln

FIELDS = {"name": ["l.name = r.name", "levenshtein(l.name, r.name) <= 2 OR l.parts = r.parts"], "city": ["l.city = r.city"], "year": ["l.year = r.year", "abs(l.year - r.year) <= 1"]}
BLOCKS = ["city", "parts"]
SCHEMA = "rec_id string, name string, parts string, city string, year int"


def people(n=300):
    """Each person once, and each third again with a typo or with the name's parts swapped."""
    rng = np.random.default_rng(6)
    syllables = ["ka", "lo", "mi", "ten", "ras", "vel", "du", "shor", "pim", "qua"]
    word = lambda: "".join(rng.choice(syllables, 4))
    rows, same = [], {}
    for i in range(n):
        first, last, city, year = word(), word(), f"city{rng.integers(40)}", int(rng.integers(1900, 2000))
        record = lambda ident, a, b, where, when: (ident, f"{a} {b}", " ".join(sorted((a, b))), where, when)
        rows.append(record(f"p{i:03}", first, last, city, year))
        if i % 3 == 0:
            kind = i // 3 % 3
            at = int(rng.integers(1, len(last) - 1))
            other = [(first, last[:at] + "x" + last[at + 1 :], city, year), (last, first, city, year + 1), (last, first, None, year)][kind]
            rows.append(record(f"q{i:03}", *other))
            same[f"q{i:03}"] = f"p{i:03}"
    return rows, same


def test_planted_variants_are_merged(spark):
    rows, same = people()
    got = {r.rec_id: r for r in ln.link_records(spark.createDataFrame(rows, SCHEMA), FIELDS, BLOCKS).collect()}
    assert len(got) == len(rows)
    merged = {i for i, r in got.items() if r.entity != i}
    right = {i for i, j in same.items() if got[i].entity == j}
    assert len(right) >= 0.95 * len(same) and len(merged & right) >= 0.97 * len(merged)


def by_hand(levels, counts, sizes, rounds):
    """The same estimate, pattern by pattern."""
    prior, best_m, best_u = ln.START
    m = [[(1 - best_m) / n] * n + [best_m] for n in sizes]
    u = [[(1 - best_u) / n] * n + [best_u] for n in sizes]
    for _ in range(rounds):
        hits = []
        for pattern in levels:
            yes, no = prior, 1 - prior
            for f, level in enumerate(pattern):
                if level >= 0:
                    yes, no = yes * m[f][level], no * u[f][level]
            hits.append(yes / (yes + no))
        prior = sum(h * c for h, c in zip(hits, counts, strict=True)) / sum(counts)
        for f, n in enumerate(sizes):
            for rates, share in ((m, hits), (u, [1 - h for h in hits])):
                got = [ln.PSEUDO + sum(s * c for p, s, c in zip(levels, share, counts, strict=True) if p[f] == level) for level in range(n + 1)]
                rates[f] = [x / sum(got) for x in got]
    return prior, m, u


def test_estimate_by_hand():
    levels, counts = [(2, 1, 2), (1, 1, 1), (0, 0, 0), (0, 1, 0), (-1, 1, 2), (0, -1, 1), (2, 0, 2)], [50, 8, 900, 300, 12, 40, 9]
    prior, m, u = ln.estimate(np.array(levels), np.array(counts, float), [2, 1, 2], 7)
    want = by_hand(levels, counts, [2, 1, 2], 7)
    assert prior == pytest.approx(want[0]) and all(np.allclose(a, b) for a, b in zip(m + u, want[1] + want[2], strict=True))


def test_planted_rates_are_found():
    rng = np.random.default_rng(1)
    match = rng.random(40000) < 0.2
    agree = np.column_stack([np.where(match, rng.random(40000) < a, rng.random(40000) < b) for a, b in ((0.95, 0.1), (0.8, 0.05), (0.9, 0.3), (0.85, 0.2))]).astype(int)
    patterns, counts = np.unique(agree, axis=0, return_counts=True)
    prior, m, u = ln.estimate(patterns, counts.astype(float), [1] * 4, 200)
    assert prior == pytest.approx(0.2, abs=0.02)
    assert [x[1] for x in m] == pytest.approx([0.95, 0.8, 0.9, 0.85], abs=0.03)
    assert [x[1] for x in u] == pytest.approx([0.1, 0.05, 0.3, 0.2], abs=0.02)


def test_copies_are_folded(spark):
    """Copies make no pairs; nulls and repeated ids stay."""
    rows, _ = people(60)
    copies = [(f"z{i}", *rows[0][1:]) for i in range(500)] + [("n1", None, None, None, None), ("n2", None, None, None, None), (None, "a b", "a b", "c", 1), rows[3]]
    df = spark.createDataFrame(rows + copies, SCHEMA)
    got = ln.link_records(df, FIELDS, BLOCKS, most=30).collect()
    assert len(got) == len(rows) + len(copies) - 1
    assert {r.entity for r in got if r.rec_id.startswith("z")} == {"p000"}
    assert {r.entity for r in got if r.rec_id.startswith("n")} == {"n1"}


def test_large_blocks_raise(spark):
    rows = [(f"r{i}", f"name{i}", f"name{i}", "one", 1900) for i in range(40)]
    with pytest.raises(ValueError, match="40 records"):
        ln.candidate_pairs(spark.createDataFrame(rows, SCHEMA), FIELDS, BLOCKS, most=39)
    none = spark.createDataFrame([], SCHEMA)
    assert ln.link_records(none, FIELDS, BLOCKS).count() == 0


def test_conflicts_are_marked(spark):
    """b is linked with a and c, which speak against each other."""
    records = spark.createDataFrame([(x, None, None, None, None) for x in "abcd"], SCHEMA)
    pairs = spark.createDataFrame([("a", "b", 5.0), ("b", "c", 4.0), ("a", "c", -12.0), ("c", "d", -20.0)], "a string, b string, weight double")
    got = {r.rec_id: (r.entity, r.conflict) for r in ln.entities(records, pairs).collect()}
    assert got == {"a": ("a", True), "b": ("a", True), "c": ("a", True), "d": ("d", False)}


def test_large_blocks_are_tiled(spark):
    """Tiles lose no pair and make none twice, and pairs aren't shuffled or stored."""
    rows = [(f"r{i:03}", f"name{i % 9}", f"parts{i % 30}", "one" if i % 4 else None, 1900 + i % 5) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = ln.candidate_pairs(df, FIELDS, BLOCKS, tile=7)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and ((a[3] and a[3] == b[3]) or a[2] == b[2])}
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Deduplicate" not in plan


def test_sieves_lose_no_pair(spark):
    """Edit distances behind sieves are those of all pairs, short and odd texts too."""
    rng = np.random.default_rng(8)
    words = ["", "a", "'", "\\\\", "ab", "ba", "aaaaaaaaaa", "aaaaaaaaaaaa", "日本語", "日本", "Customer#000000012", "Customer#000000021", "000000012 Customer", None]
    words += ["".join(rng.choice(list("abé#1 "), int(rng.integers(0, 9)))) for _ in range(110)]
    df = spark.createDataFrame([(f"r{i:03}", w, "x") for i, w in enumerate(words)], "rec_id string, name string, city string")
    for k in range(4):
        pairs = ln.candidate_pairs(df, {"name": [f"levenshtein(l.name, r.name) <= {k}"]}, ["city"], tile=50)
        plain = df.alias("l").join(df.alias("r"), F.expr("l.rec_id < r.rec_id"))
        want = plain.selectExpr("l.rec_id AS a", "r.rec_id AS b", f"CASE WHEN l.name IS NULL OR r.name IS NULL THEN -1 WHEN levenshtein(l.name, r.name) <= {k} THEN 1 ELSE 0 END AS g")
        assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, want.collect()))
    assert "once_name" in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_a_pair_of_tiles_meets_once(spark):
    """Records are copied to the tiles from theirs on, as left sides, or up to theirs, as right ones."""
    df = spark.createDataFrame([(f"r{i:03}", f"name{i}", None, "one", 1900) for i in range(100)], SCHEMA)
    left, right, _ = ln._tiles(df, FIELDS, BLOCKS, tile=10)
    assert left.count() == right.count() == 10 * sum(range(1, 11))
    assert left.where("i > j").isEmpty() and right.where("i > j").isEmpty()


def test_weights_are_looked_up(spark):
    """Each pattern has one weight, made once: no pair's sum is rounded."""
    rows, _ = people(90)
    pairs = ln.candidate_pairs(spark.createDataFrame(rows, SCHEMA), FIELDS, BLOCKS)
    got = ln.weighted(pairs, FIELDS)
    assert "round(" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = sorted(map(tuple, got.collect()))
    most, ln.MOST_PATTERNS = ln.MOST_PATTERNS, 1
    try:
        summed = sorted(map(tuple, ln.weighted(pairs, FIELDS).collect()))
    finally:
        ln.MOST_PATTERNS = most
    assert found == summed and len(found) > 90
