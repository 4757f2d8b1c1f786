import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import awkward, empty, rows
from evigraph.llm import toxicity as tx

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(8)
    plain, bad = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)], ["vilething", "nastyword", "grimslur", "zorkling", "zorkler", "zorkest"]
    docs, labels = [], []
    for i in range(900):
        words = rng.choice(plain, 60).tolist()
        toxic = int(i % 8 == 0)
        if toxic:
            for w in rng.choice(bad, 3):
                words[int(rng.integers(0, 60))] = str(w)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    got = tx.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_held_out_labels_are_not_used(corpus):
    docs, labels = corpus
    turned = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in tx.toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_awkward(spark, corpus):
    docs, labels = corpus
    model = tx.fit(docs, labels)
    out = tx.with_scores(awkward(spark), model, name="tox").collect()
    assert len(out) == len(rows()) and all(r.tox < 0.5 for r in out)
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, None, 1), (2, 1, 0)], LABELS)
    assert tx.toxicity(awkward(spark), odd).where("score IS NULL").count() == 0
    assert tx.toxicity(awkward(spark), labels.limit(0)).where("predicted <> 0").count() == 0
    assert tx.toxicity(empty(spark), labels).count() == 0


def test_rows_for_fitting_are_bounded(corpus):
    docs, labels = corpus
    assert tx.training_rows(docs, labels, 50).count() == 50


def planted_votes(says, n=20000, prior=0.3, seed=0):
    """Votes of independent voters with these rates, a tenth of them silent."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < prior).astype(int)
    says = np.asarray(says)
    votes = np.where(rng.random((n, len(says))) < says[:, y].T, 1, -1)
    return y, np.where(rng.random(votes.shape) < 0.1, 0, votes)


def test_planted_accuracies_are_found_without_labels():
    says = [(0.05, 0.8), (0.1, 0.6), (0.02, 0.4), (0.2, 0.7), (0.01, 0.3)]
    y, votes = planted_votes(says)
    model = tx.fit_label_model(votes, 0.3)
    assert np.abs(model.says - says).max() < 0.03
    assert (model.weight > 0.9).all()
    assert np.mean((model.posterior(votes) >= 0.5) == y) > 0.93


def test_planted_correlation_is_found_without_labels():
    says = [(0.05, 0.8), (0.1, 0.6), (0.08, 0.7), (0.2, 0.7)]
    _, votes = planted_votes(says)
    rng = np.random.default_rng(5)
    shadow = np.where(rng.random(len(votes)) < 0.95, votes[:, 1], -1)  # mostly repeats voter 1
    model = tx.fit_label_model(np.c_[votes, shadow], 0.3)
    assert model.correlation[1, 4] > 0.7
    others = [model.correlation[i, j] for i in range(4) for j in range(i)]
    assert max(others) < 0.15
    assert model.weight[1] < 0.65 and model.weight[4] < 0.65 and model.weight[0] > 0.85


def likelihood(votes, prior, says):
    """Log-likelihood of the votes under independent voters."""
    total = 0.0
    for v in votes:
        parts = [1 - prior, prior]
        for j, x in enumerate(v):
            for c in (0, 1):
                parts[c] *= says[j][c] if x > 0 else 1 - says[j][c] if x < 0 else 1
        total += np.log(sum(parts))
    return total


def test_em_reaches_the_greatest_likelihood():
    """Against a search of the whole grid of rates for three voters."""
    says = [(0.1, 0.8), (0.1, 0.7), (0.2, 0.9)]
    _, votes = planted_votes(says, 120, 0.4, 3)
    model = tx.fit_label_model(votes, 0.4, prior_votes=0.0, rounds=2000)
    model.weight[:] = 1
    grid = np.arange(0.05, 1, 0.15)
    low, high = np.meshgrid(grid, grid, indexing="ij")
    one = np.stack([low.ravel(), high.ravel()], 1)  # rates of one voter
    kinds, times = np.unique(votes, axis=0, return_counts=True)

    def terms(c):  # kind x candidate, for each voter
        return [np.where(kinds[:, j, None] > 0, one[:, c], np.where(kinds[:, j, None] < 0, 1 - one[:, c], 1.0)) for j in range(3)]

    clean, toxic = terms(0), terms(1)
    total = sum(
        t * np.log(0.6 * clean[0][k][:, None, None] * clean[1][k][None, :, None] * clean[2][k] + 0.4 * toxic[0][k][:, None, None] * toxic[1][k][None, :, None] * toxic[2][k])
        for k, t in enumerate(times)
    )
    assert likelihood(votes, 0.4, model.says) >= total.max() - 0.5


def test_voters_have_both_polarities():
    voters = [frozenset({"vile"}), frozenset({"^zork"})]
    silent = [0] * len(tx.PATTERNS)
    assert tx.cast_votes("a vile zorkling " + "word " * 30, voters) == [1, 1, *silent]
    assert tx.cast_votes("plain word " * 30, voters) == [-1, -1, *silent]
    assert tx.cast_votes("short", voters) == [-1, -1, *silent]
    assert tx.cast_votes("", voters) == [0, 0, *silent]


def test_linear_model_is_the_penalised_optimum():
    rng = np.random.default_rng(4)
    x = rng.random((60, 4)) < 0.4
    target, times = rng.random(60), rng.integers(1, 4, 60).astype(float)
    row, col = np.nonzero(x)
    beta = tx.fit_linear(row, col, 4, target, times)
    p = 1 / (1 + np.exp(-(x @ beta[:4] + beta[4])))
    assert np.abs(x.T @ (times * (target - p)) - 0.05 * beta[:4]).max() < 1e-5
    assert abs((times * (target - p)).sum()) < 1e-5


def test_best_shift():
    z, y = np.array([-3.0, -1.0, 1.0, 2.0]), np.array([0, 0, 1, 1])
    assert tx.best_shift(z, y) == pytest.approx(0.0)
    assert tx.best_shift(z + 5, y) == pytest.approx(-5.0)
    assert tx.best_shift(np.zeros(0), np.zeros(0)) == 0


def test_ids_that_are_not_numbers(spark, corpus):
    docs, labels = (d.withColumn("doc_id", F.concat(F.lit("n"), "doc_id")) for d in corpus)
    got = tx.toxicity(docs, labels).join(labels, "doc_id")
    assert got.where("predicted = toxic").count() > 0.97 * got.count()


@pytest.mark.parametrize("size,bad_words,share", [(3, 1, 0.2), (3, 2, 0.2), (12, 2, 0.2), (19, 2, 0.2), (12, 2, 0.62), (None, 2, 0.1)])
def test_short_texts_are_told_apart(spark, size, bad_words, share):
    """Texts of few words, of all lengths, and where most are toxic; empty ones stay."""
    rng = np.random.default_rng(1)
    plain, bad = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)], [f"{'vile' if i % 2 else 'grim'}{chr(97 + i)}thing" for i in range(20)]
    docs, labels = [(-1, ""), (-2, None)], []
    for i in range(2000):
        n = size or int(rng.choice([3, 8, 20, 120]))
        words, toxic = rng.choice(plain, n).tolist(), int(rng.random() < share)
        for at in rng.choice(n, bad_words, replace=False) if toxic else ():
            words[at] = str(rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    got = tx.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)).collect()
    held = [r for r in got if r.held_out and r.doc_id >= 0]
    assert np.mean([r.predicted for r in held if labels[r.doc_id][2]]) >= 0.9
    assert np.mean([r.predicted for r in held if not labels[r.doc_id][2]]) <= 0.02
    assert all(r.score < 0.5 for r in got if r.doc_id < 0)
