"""Registered queries against their SQL, and the awkward cases of each operator."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import awkward, empty, rows
from evigraph.llm import mixing, packing, secret_scan, url_filter
from evigraph.llm.queries import ORACLE_SQL, QUERIES
from oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, data, name):
    assert assert_same(QUERIES[name](spark, data), connect(data), ORACLE_SQL[name]) > 0


# --- mixing -----------------------------------------------------------------------


def test_marginals_are_met(spark):
    docs = [(i, " ".join(["w"] * 10), ["en", "de"][i % 2], f"s{i % 5 // 2}") for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    targets = {"source": {"s0": 0.5, "*": 0.5}, "lang": {"en": 0.3, "de": 0.7}, "topic": {"*": 1.0}}
    out = mixing.mix(df, targets, budget=0.3, topic=F.lit("t")).withColumn("w", F.col("probability") * F.col("n_tokens"))
    total = out.agg(F.sum("w")).first()[0]
    assert total == pytest.approx(0.3 * 40000, rel=1e-6)
    shares = lambda c: {r[0]: r[1] / total for r in out.groupBy(c).agg(F.sum("w")).collect()}
    assert shares("mix_source") == pytest.approx({"s0": 0.5, "*": 0.5}, abs=1e-6)
    assert shares("mix_lang") == pytest.approx({"en": 0.3, "de": 0.7}, abs=1e-6)
    taken = out.where("sampled").agg(F.sum("n_tokens")).first()[0]
    assert taken == pytest.approx(total, rel=0.08)


def test_mixing_awkward(spark):
    out = mixing.mix(awkward(spark), keep=awkward(spark).columns)
    assert out.count() == len(rows())
    assert out.where("probability < 0 OR probability > 1 OR probability IS NULL OR sampled IS NULL").count() == 0
    assert mixing.mix(empty(spark)).count() == 0


def test_registered_targets(spark, data):
    """Every marginal is met, or its category can't supply it."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = mixing.residuals(mixing.mix(docs)).collect()
    assert {(r.marginal, r.category) for r in found} >= {(n, c) for n, t in mixing.TARGETS.items() for c in t}
    for name in mixing.TARGETS:
        assert sum(r.share for r in found if r.marginal == name) == pytest.approx(1)
    assert all(r.residual < 0 for r in found if r.supply is not None and r.supply < 0.999)


def test_residuals_vanish_where_targets_can_be_met(spark):
    docs = [(i, "w " * 10, ["en", "de"][i % 2], f"s{i % 5 // 2}") for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    targets = {"source": {"s0": 0.5, "*": 0.5}, "lang": {"en": 0.3, "de": 0.7}, "topic": {"*": 1.0}}
    found = mixing.residuals(mixing.mix(df, targets, budget=0.3, topic=F.lit("t")), targets).collect()
    assert len(found) == 5 and all(abs(r.residual) < 1e-6 and r.supply >= 1 for r in found)


def test_any_category_names(spark):
    docs = [(1, "a b", "en", "o'x"), (2, "c d", "e\\n", "p"), (3, "e f", None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    targets = {"source": {"o'x": 0.4, "p": 0.3, "*": 0.3}, "lang": {"e\\n": 0.3, "*": 0.7}, "topic": {"prose": 1.0}}
    out = {r.doc_id: (r.mix_source, r.mix_lang) for r in mixing.mix(df, targets).collect()}
    assert out == {1: ("o'x", "*"), 2: ("p", "e\\n"), 3: ("*", "*")}
    with pytest.raises(ValueError, match="cells"):
        mixing.mix(df, targets | {"source": {str(i): 0.0 for i in range(9000)}})


# --- packing ----------------------------------------------------------------------


def brute_padding(lengths, counts, buckets):
    from itertools import combinations

    n = len(lengths)
    best = None
    for cuts in combinations(range(1, n), min(buckets, n) - 1):
        edges = [0, *cuts, n]
        cost = sum(c * (lengths[e - 1] - x) for a, e in zip(edges, edges[1:]) for x, c in zip(lengths[a:e], counts[a:e]))
        best = cost if best is None else min(best, cost)
    return best


def test_bounds_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(25):
        n = int(rng.integers(1, 10))
        lengths, counts = np.sort(rng.choice(60, n, replace=False)), rng.integers(1, 9, n)
        for k in (1, 2, 3, 12):
            bounds = packing.bucket_bounds(lengths, counts, k)
            cost = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))
            assert len(bounds) <= k and cost == brute_padding(lengths.tolist(), counts.tolist(), k)


def check_batches(out, batch_tokens):
    seen = {}
    for r in out:
        assert r.n_tokens <= r.bucket_len
        seen.setdefault((r.bucket, r.bucket_len), []).append((r.batch, r.slot))
    for (_, size), places in seen.items():
        room = max(1, batch_tokens // max(size, 1))
        assert sorted(places) == [divmod(i, room) for i in range(len(places))]


def test_packing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = packing.pack(docs, max_len=300, buckets=5, batch_tokens=2000, shard_rows=20).collect()
    check_batches(out, 2000)
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == words


def test_packing_awkward(spark):
    out = packing.pack(awkward(spark), max_len=1000).collect()
    check_batches(out, 65536)
    assert sum(r.n_tokens for r in out if r.doc_id == 9) == 30000
    assert {r.n_tokens for r in out if r.doc_id in (3, 4, 10)} == {0}
    assert packing.pack(empty(spark)).count() == 0


def test_packing_does_not_depend_on_the_partitions(spark):
    docs = spark.range(1001).selectExpr("id AS doc_id", "repeat('w ', int(id % 37)) AS text")
    docs = docs.unionByName(spark.range(300).selectExpr("NULL AS doc_id", "'the same words' AS text"))
    places = lambda n: sorted(map(tuple, packing.pack(docs.repartition(n), 20, 4, 200, shard_rows=7).collect()), key=str)
    first = places(1)
    assert len(first) == len(set(first)) and places(3) == first and places(7) == first
    check_batches(packing.pack(docs, 20, 4, 200, shard_rows=7).collect(), 200)


# --- URLs -------------------------------------------------------------------------


def brute_verdict(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls_awkward(spark):
    urls = [None, "", "nothing", "http://", "http://com", "http://COM/", "https://a.Example.com/en/x?y=/fr/#z", "http://www.example.com/en/", "http://xexample.com/en/", "ftp://net/es/1", "http://net/fr", "http://a.net#/es/", "http://ÄB.net/es/", "a://b://net/es/", "http://n.net/es/\nx", "http://a..com/q"]
    df = spark.createDataFrame([(i if i else None, u, "r", "v") for i, u in enumerate(urls)] + [(3, urls[6], "r", "v")] * 2, "page_id long, url string, rule string, keys string")
    got = sorted((tuple(r) for r in url_filter.url_verdicts(df).collect()), key=str)
    assert got == sorted([(i if i else None, *brute_verdict(u)) for i, u in enumerate(urls)] + [(3, *brute_verdict(urls[6]))] * 2, key=str)
    assert url_filter.url_verdicts(df.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 3000, 7)], "key string")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    levels = url_filter.build_cascade(listed, universe)
    assert len(levels.levels) > 1 and not levels.left
    wrong = universe.join(listed.withColumn("l", F.lit(True)), "key", "left").where(url_filter.is_listed(levels, F.col("key")) != F.coalesce("l", F.lit(False)))
    assert wrong.count() == 0


def test_cascade_ends_where_levels_do_not_tell(spark):
    """Two keys that no level tells apart: here since no second level is allowed."""
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 3000, 7)], "key string")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    cascade = url_filter.build_cascade(listed, universe, most_levels=1)
    assert len(cascade.levels) == 1 and cascade.left
    wrong = universe.join(listed.withColumn("l", F.lit(True)), "key", "left").where(url_filter.is_listed(cascade, F.col("key")) != F.coalesce("l", F.lit(False)))
    assert wrong.count() == 0


def test_levels_hash_apart(spark):
    """Keys that have the same positions in one level have others in the next."""
    keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    first, second = (F.concat_ws(",", *url_filter._probes(F.col("key"), 70, 1, salt)) for salt in (0, 1))
    both = keys.select(first.alias("a"), second.alias("b")).groupBy("a").agg(F.countDistinct("b").alias("n"))
    assert both.where("n < 10").count() == 0


def test_a_million_rules(spark):
    rules = [(f"h{i}.com", "/", "block") for i in range(1_000_000)] + [("com", "/", "allow")]
    pages = spark.range(20000).selectExpr("id AS page_id", "concat('http://x.h', id * 100, '.com/') AS url")
    got = url_filter.url_verdicts(pages, rules).groupBy("verdict").count().collect()
    assert dict(map(tuple, got)) == {"block": 10000, "allow": 10000}


# --- secrets ----------------------------------------------------------------------


def test_secrets(spark):
    key, hexes = "AKIA" + "Z" * 16, "0123456789abcdef01234567"
    texts = [
        f"é😀 Token = 'abcdef' and {hexes}", f"{key} near {'Ab3/' * 10} at https://h.example/x", f"{'Ab3/' * 10} alone", "api_key=token:abcdef password : xyz", None, "",
        f"client_id = acct-77 then secret=hunter22", f"{key}" + " " * 400 + "Ab3/" * 10,
    ]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)] + [(2, texts[2], "s", 1)], "doc_id long, text string, spans string, row int")
    got = {}
    for r in secret_scan.scan(df).collect():
        got[r.doc_id] = [(secret_scan.KINDS[x.k], x.s, x.e) for x in r.spans]
    assert got[0] == [("assign", 3, 18), ("hex", 24, 48)]
    assert got[1] == [("access", 0, 20), ("weak_secret", 26, 66), ("endpoint", 70, 89)]
    assert got[2] == [] and got[4] == [] and got[5] == []
    assert got[3] == []  # "token" is a value of five characters, "xyz" of three
    assert got[6] == [("weak_id", 0, 19), ("assign", 25, 40)]
    assert got[7] == [("access", 0, 20)]
    assert secret_scan.scan(df).count() == 9 and secret_scan.scan(df.limit(0)).count() == 0


def test_long_parts_stay_linked(spark):
    """The scope is measured between the spans, not between their starts."""
    text = "client_id=acct77 " + "Ab3/" * 100 + " https://h.example/x"
    far = "client_id=acct77 " + "Ab3/" * 10 + " " * 300 + "https://h.example/x"
    df = spark.createDataFrame([(1, text), (2, far)], "doc_id long, text string")
    got = {r.doc_id: [(secret_scan.KINDS[x.k], x.s, x.e) for x in r.spans] for r in secret_scan.scan(df).collect()}
    assert got[1] == [("weak_id", 0, 16), ("weak_secret", 17, 417), ("endpoint", 418, 437)]
    assert got[2] == [("weak_id", 0, 16), ("weak_secret", 17, 57)]


def test_many_matches_in_a_text(spark):
    """Time is in proportion to the matches: twice as many take about twice as long."""
    seconds = []
    for n in (16000, 32000):
        df = spark.createDataFrame([(1, " ".join(f"token=abcdef{i}" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        (row,) = secret_scan.scan(df).collect()
        seconds.append(time.time() - began)
        assert len(row.spans) == n
        assert all(x.s == 0 or x.s == row.spans[i - 1].e + 1 for i, x in enumerate(row.spans))
    assert seconds[1] < 3 * seconds[0] + 2


def test_secrets_awkward(spark):
    assert secret_scan.scan(awkward(spark)).count() == len(rows())
