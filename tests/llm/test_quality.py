"""Quality rules against plain Python on small corpora."""

import re
from collections import Counter, defaultdict

import pytest

from cases import awkward, empty
from evigraph.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(docs, least, share, least_words, least_part):
    """doc -> the counts, from (row, id, text, host)."""
    normal = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()
    texts, having = defaultdict(set), defaultdict(set)
    for _, _, text, host in docs:
        texts[host].add(text)
        for line in (text or "").split("\n"):
            if WORD.search(line):
                having[host, normal(line)].add(text)
    common = {k for k, v in having.items() if len(v) > least and len(v) > share * len(texts[k[0]])}
    out = []
    for _, ident, text, host in docs:
        words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
        gone = [x for x in lines if (host, normal(x)) in common]
        left = len(words) - sum(len(WORD.findall(x)) for x in gone)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        depleted = bool(gone) and (left < least_words or left < least_part * len(words))
        out.append(
            (ident, len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed, len(gone), left, depleted, not failed and not depleted)
        )
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_left_words", "depleted", "kept"]


def corpus():
    notice, body = "Read our  Terms and\tconditions # before use", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu "
    docs = [(i, i, f"{notice}\n" + " ".join(f"w{i}x{j}" for j in range(70)), "a") for i in range(8)]
    docs += [(20 + i, 20 + i, f"{notice.upper()}\n{body * 2}\nown{i} é{i}", "a") for i in range(6)]
    docs += [(40 + i, 40, "same text here\n" + "x y z " * 40, "b") for i in range(9)]
    docs += [(60 + i, 60 + i, f"{notice}\n" + " ".join(f"v{i}x{j}" for j in range(55)), None) for i in range(3)]
    return docs + [(90, None, None, "a"), (91, 91, "", "b"), (92, 92, " \n\t\n", "b"), (93, 93, "\x0b a b\x0c", "b"), (94, 94, "a b c a b c a b", "c")]


@pytest.mark.parametrize("most", [100, 0])
def test_same_by_hand(spark, most):
    docs = corpus()
    df = spark.createDataFrame(docs, "row long, doc_id long, text string, source string")
    got = qr.quality(df, 5, 0.3, 20, 0.5, max_lines=most, salts=3).select(*COLUMNS).collect()
    want = by_hand(docs, 5, 0.3, 20, 0.5)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert any(r[9] for r in want) and any(r[7] and r[10] for r in want)


def test_copies_are_one_document(spark):
    """Nine copies in host b don't make their line frequent."""
    got = qr.quality(spark.createDataFrame(corpus(), "row long, doc_id long, text string, source string"), 5, 0.0)
    assert {r.n_removed_lines for r in got.where("doc_id = 40").collect()} == {0}


def test_texts_without_frequent_lines(spark):
    df = spark.createDataFrame(corpus(), "row long, doc_id long, text string, source string")
    for most in (100, 0):
        got = {r.row: r.text for r in qr.without_frequent_lines(df, 5, 0.3, max_lines=most).collect()}
        for row, _, text, host in corpus():
            cut = text if host != "a" or text is None else "\n".join(x for x in text.split("\n") if not x.lower().startswith(("read our", "alpha")))
            assert got[row] == cut


def test_awkward_rows(spark):
    got = qr.quality(awkward(spark))
    assert got.count() == awkward(spark).count()
    by_id = {r.doc_id: r for r in got.collect()}
    assert not by_id[3].kept and by_id[3].n_words == 0 and by_id[9].n_repeat_words == 30000 and by_id[9].base_failed
    assert qr.quality(empty(spark)).count() == 0
    assert qr.without_frequent_lines(awkward(spark)).columns == awkward(spark).columns
