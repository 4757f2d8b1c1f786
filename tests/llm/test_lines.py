"""Line dedup against a comparison of all windows of all lengths."""

import random

import pytest
from pyspark.sql import functions as F

from cases import LINE, OTHER, awkward, empty, rows
from evigraph.llm import line_dedup


def brute_copies(texts):
    """For each (document, line): the longest run from there with an earlier copy."""
    lines = [t.split("\n") for t in texts]
    places = [(d, i) for d, own in enumerate(lines) for i, line in enumerate(own) if line.strip()]
    out = {}
    for d, i in places:
        best = 0
        for e, j in places:
            if (e, j) >= (d, i):
                break
            n = 0
            while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n] == lines[e][j + n] and lines[d][i + n].strip():
                n += 1
            best = max(best, n)
        out[d, i] = best
    return lines, out


def brute_dedup(texts, min_words):
    lines, copies = brute_copies(texts)
    out = []
    for d, own in enumerate(lines):
        gone, runs = set(), 0
        for i in range(len(own)):
            n = copies.get((d, i), 0)
            if not n or copies.get((d, i - 1), 0) - 1 >= n:
                continue
            if sum(len(line.split()) for line in own[i : i + n]) >= min_words:
                gone |= set(range(i, i + n))
                runs += 1
        left = texts[d] if not gone else "\n".join(line for i, line in enumerate(own) if i not in gone)
        longest = max([copies.get((d, i), 0) for i in range(len(own))])
        out.append((d, left, len(own), len(gone), runs, longest))
    return out


def found(spark, texts, min_words=5):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = line_dedup.dedup_lines(df, min_words).select("doc_id", "text", "n_lines", "n_removed", "n_runs", "longest_run")
    return sorted(tuple(r) for r in out.collect())


def test_lines_awkward(spark):
    out = line_dedup.dedup_lines(awkward(spark))
    assert out.columns == [*[c for c in awkward(spark).columns], "n_lines", "n_removed", "n_runs", "longest_run"]
    got = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()}
    assert (1, f"{LINE}\n{OTHER}", 2, 0) in got
    assert (2, "intro words here\nouttro", 4, 2) in got
    assert (5, "", 2, 2) in got and (3, None, 0, 0) in got and (4, "", 1, 0) in got
    assert out.count() == len(rows())
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_runs(spark):
    """Short lines go only as part of a run that is long enough."""
    texts = ["a b\nc d\ne f\nx", "q\na b\nc d\ne f", "a b\nsomething new", "e f\nnew too\na b\nc d"]
    assert found(spark, texts) == [
        (0, texts[0], 4, 0, 0, 0), (1, "q", 4, 3, 1, 3), (2, texts[2], 2, 0, 0, 1), (3, texts[3], 4, 0, 0, 2),
    ]


def test_a_run_occurs_as_a_whole(spark):
    """Pairs that are repeated in different documents make two runs, not one of three."""
    texts = ["A B\nC D\nq1", "C D\nE F\nq2", "A B\nC D\nE F"]
    assert found(spark, texts, 5)[2] == (2, texts[2], 3, 0, 0, 2)
    assert found(spark, texts, 4)[2] == (2, "", 3, 3, 2, 2)
    assert found(spark, [*texts, "z9\nA B\nC D\nE F"], 5)[3] == (3, "z9", 4, 3, 1, 3)


@pytest.mark.parametrize("seed", range(3))
def test_same_as_all_windows(spark, seed):
    """Few distinct lines, so that runs of all lengths repeat, overlap and end anywhere."""
    rng = random.Random(seed)
    alphabet = ["a", "b b", "c c c", "d", " ", f"u{seed} v w x y"]
    texts = ["\n".join(rng.choices(alphabet, (5, 5, 3, 1, 1, 1), k=rng.randint(1, 17))) for _ in range(20)]
    texts += [texts[3], texts[4] + "\n" + texts[5], "\n".join(["a"] * 23), "\n".join(["a"] * 9)]
    assert found(spark, texts, 3) == brute_dedup(texts, 3)


def test_ranks_are_the_suffix_array(spark):
    texts = ["b\na\nn\na\nn\na", "a\nn\na"]
    keyed = line_dedup._keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    placed, _ = line_dedup.place_lines(line_dedup.line_rows(keyed, "text"))
    at = {r.pos: (r.h1, r.h2) for r in placed.collect()}  # "b" is unique and a gap
    levels = line_dedup.suffix_ranks(placed)
    suffix = {p: [at[q] for q in range(p, p + 8) if all(r in at for r in range(p, q + 1))] for p in at}
    for width, level in zip((1, 2, 4, 8), levels, strict=False):
        got = {r.pos: r["rank"] for r in level.collect()}
        assert got == {p: 1 + sum(suffix[o][:width] < suffix[p][:width] for o in at) for p in got}


def test_one_common_line(spark):
    """A line of very many documents with other lines around it: only it goes."""
    common = "one two three four five six"
    df = spark.range(3000).selectExpr("id AS doc_id", f"concat('own ', id, '\n{common}\nmore ', id) AS text")
    out = line_dedup.dedup_lines(df).where("n_removed > 0")
    assert out.agg(F.count("*"), F.max("n_removed"), F.max("longest_run")).first() == (2999, 1, 1)
