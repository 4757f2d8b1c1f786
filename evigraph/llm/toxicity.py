"""Toxicity by weak supervision.

Voters look at a text and say toxic, clean or nothing. A *lexicon voter* has a
list of words, a *pattern voter* a list of word beginnings or an expression. It
says toxic on a hit and clean if a text of one word or more has none; a text
without words leaves it silent. One lexicon is fixed; the other lists are
proposed from the labelled training rows (words and beginnings that are more
frequent in toxic texts), dealt to many voters of uneven quality.

How good the voters are isn't read off the labels. A generative model with one
latent class estimates from their agreement alone how often each says toxic in
either class, and which of them stay correlated when the class is known; those
share their weight. Of the labels it gets the share of toxic texts only.

Its posteriors, not the labels, are the targets of a linear classifier on the
words and word beginnings of the text, voters or not, and that classifier scores
every whole text. The labels choose the point at which a score is 0.5.

Everything is fitted on a sample of labelled rows bounded by ``max_rows``; every
text is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_table, documents

#: Most labelled rows that are read for fitting, most features proposed to the
#: voters, and most features of the classifier.
MAX_ROWS, MAX_PROPOSED, MAX_FEATURES = 20000, 600, 3000
#: A proposed feature is toxic at least this often, with at least this
#: log-likelihood ratio against an equal rate.
LEAST_PRECISION, LEAST_G2 = 0.6, 10.0
#: The same ratio for a feature of the classifier, against posteriors.
LEAST_FEATURE_G2 = 6.0
#: Voters made of the proposed features of each kind.
VOTERS_OF_KIND = 8
#: Most that a text without words gets, as a logit: nothing in it is toxic.
NO_WORDS = -1.0
#: Correlations below this count as noise.
LEAST_CORRELATION = 0.1
#: Lengths of the word beginnings.
PREFIXES = (4, 5, 6)
#: A word: letters, also accented ones.
LETTERS = re.compile(r"[^\W\d_]{3,}")

# Common insults in the four languages.
INSULTS = {
    "idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "jerk", "fool", "bastard",
    "dummkopf", "trottel", "abschaum", "widerlich", "depp", "imbécile", "crétin", "connard", "salaud", "idiota", "estúpido", "imbécil", "basura", "cabrón",
}
# Expressions that speak for abuse.
PATTERNS = (
    re.compile(r"\b(?:you|your|du|ihr|tu|vous|eres)\b[^.!?\n]{0,40}\b(?:idiot\w*|moron\w*|stupid\w*|loser\w*|trash|scum|clown\w*|dumm\w*|crétin\w*|imbécil\w*)", re.I),
    re.compile(r"[!?]{3,}"),
    re.compile(r"\b(?:shut up|go away|hate you|kill yourself|halt die klappe|ta gueule|cállate)\b", re.I),
)


def held_out(ident: Column) -> Column:
    """True for one row in five by the CRC-32 of the id; null counts as ''."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def word_features(words: set[str]) -> set[str]:
    """A text's words and, marked by ``^``, their beginnings."""
    found = set(words)
    for n in PREFIXES:
        found.update(["^" + w[:n] for w in words if len(w) > n])
    return found


def features(text: str) -> set[str]:
    return word_features(set(LETTERS.findall(text.lower())))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, toxic`` of at most ``max_rows`` labelled rows that aren't held out.

    Rows are chosen by a hash of the id. An id with several labels counts as
    toxic if one of them says so, and of several texts the first in order is
    taken; null labels and ids are left out.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where("id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("id")))
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    return found.select("text", F.col("toxic").cast("double").alias("toxic"))


def feature_counts(rows: DataFrame) -> DataFrame:
    """``feature, toxic_docs, clean_docs``: sums of ``toxic`` and of its complement
    over the rows with the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, total = Counter(), Counter()
        for batch in batches:
            for text, share in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                own = features(text)
                total.update(own)
                if share > 0:
                    for x in own:
                        toxic[x] += share
        names = list(total)
        t = [float(toxic[x]) for x in names]
        c = [total[x] - toxic[x] for x in names]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(t, pa.float64()), pa.array(c, pa.float64())], ["feature", "t", "c"])

    counts = rows.select("text", "toxic").mapInArrow(run, "feature string, t double, c double")
    return counts.groupBy("feature").agg(F.sum("t").alias("toxic_docs"), F.sum("c").alias("clean_docs"))


def telling_features(counts: DataFrame, toxic: float, clean: float, most: int, least_g2: float, precision: float) -> list[str]:
    """The features that tell toxic texts best, by log-likelihood ratio."""
    a, b = F.col("toxic_docs"), F.col("clean_docs")
    expected = (a + b) * (toxic / (toxic + clean))
    g2 = 2 * (a * F.log(a / expected) + F.when(b > 1e-9, b * F.log(b / (a + b - expected))).otherwise(0.0))
    strong = counts.where((a > 0) & (a >= precision * (a + b)) & (a > expected)).withColumn("g2", F.round(g2, 6)).where(F.col("g2") >= least_g2)
    return [r["feature"] for r in strong.orderBy(F.desc("g2"), "feature").limit(most).select("feature").collect()]


def deal_voters(proposed: list[str], each: int = VOTERS_OF_KIND) -> list[frozenset[str]]:
    """The fixed lexicon, and the proposed features dealt to voters.

    The features of a kind (words, or beginnings of one length) are split into
    strong and weak halves and each half is dealt in turn to ``each / 2`` voters.
    """
    kinds: dict[int, list[str]] = {}
    for f in proposed:  # strongest first
        kinds.setdefault(len(f) if f.startswith("^") else 0, []).append(f)
    voters = [frozenset(INSULTS)]
    for _, own in sorted(kinds.items()):
        half, deal = (len(own) + 1) // 2, max(1, each // 2)
        for part in (own[:half], own[half:]):
            voters += [frozenset(part[i::deal]) for i in range(min(deal, len(part)))]
    return voters


def cast_votes(text: str, voters: list[frozenset[str]]) -> list[int]:
    """1 for toxic, -1 for clean, 0 for nothing: lexicons first, then expressions."""
    words = LETTERS.findall(text.lower())
    own = word_features(set(words))
    silent = -1 if words else 0
    return [silent if own.isdisjoint(v) else 1 for v in voters] + [1 if p.search(text) else 0 for p in PATTERNS]


@dataclass
class LabelModel:
    """One latent class. ``says[j, y]`` is how often voter ``j``, if it speaks,
    says toxic in class ``y``; ``weight`` is less than one for voters whose votes
    are correlated given the class."""

    prior: float
    says: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        toxic = np.log(self.says[:, 1] / self.says[:, 0]) * self.weight
        clean = np.log((1 - self.says[:, 1]) / (1 - self.says[:, 0])) * self.weight
        z = np.log(self.prior / (1 - self.prior)) + (votes > 0) @ toxic + (votes < 0) @ clean
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def class_correlations(votes: np.ndarray, post: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Correlation of each pair of voters, where both speak, given the class.

    A row of votes stands for ``times`` texts.
    """
    spoken = (votes != 0).astype(float)
    cov, var = np.zeros((2, votes.shape[1], votes.shape[1]))
    for p in ((1 - post) * times, post * times):
        rate = np.divide(p @ (votes > 0), p @ spoken, out=np.zeros(votes.shape[1]), where=p @ spoken > 0)
        centred = ((votes > 0) - rate) * spoken * np.sqrt(p)[:, None]
        cov += centred.T @ centred
        var += (centred**2).T @ spoken  # of j where k speaks as well
    scale = np.sqrt(var * var.T)
    return np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 1e-9)


def agreement_correlations(votes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The correlations that one latent class doesn't explain, from agreement alone.

    If only the class links the voters, the correlation of two is the product of
    theirs with the class, whose square follows from any three voters. The
    median over all threes stands against some linked pairs; what a pair has
    beyond the product is its correlation given the class.
    """
    size = votes.shape[1]
    both = class_correlations(votes, np.zeros(len(votes)), times)
    square = np.zeros(size)
    for i in range(size):
        others = np.delete(np.arange(size), i)
        j, k = (others[x] for x in np.triu_indices(len(others), 1))
        use = both[j, k] > 0.01
        if use.any():
            threes = both[i, j[use]] * both[i, k[use]] / both[j[use], k[use]]
            square[i] = np.clip(np.quantile(threes, 0.5, method="lower"), 0, 0.98)
    with_class = np.sqrt(square)
    beyond = (both - np.outer(with_class, with_class)) / np.sqrt(np.outer(1 - square, 1 - square))
    return np.clip(beyond, -1, 1)


def shared_weights(correlation: np.ndarray) -> np.ndarray:
    """A voter's weight: one over the sum of its correlations that aren't noise."""
    linked = np.where(correlation >= LEAST_CORRELATION, correlation, 0)
    np.fill_diagonal(linked, 1)
    return 1 / linked.sum(axis=1)


def fit_label_model(votes: np.ndarray, prior: float, times: np.ndarray | None = None, rounds: int = 200, prior_votes: float = 0.5) -> LabelModel:
    """EM over the votes, without labels; ``prior`` is the share of toxic texts.

    Starts with the texts toxic of which some voter says so, nearly certain: from
    a soft start, correlated voters, which share one weight, are drawn to the
    point at which the classes are alike. Each rate has
    ``prior_votes`` made-up votes of either kind. Weights are first set by the
    correlations that show in agreement, then by those that the estimated class
    leaves, and the rates are estimated again with them, until the weights rest.
    """
    times = np.ones(len(votes)) if times is None else times
    size = votes.shape[1]
    yes, no = (votes > 0).astype(float), (votes < 0).astype(float)
    post = np.where(yes.any(axis=1), 0.99, 0.005)
    linked = agreement_correlations(votes, times)
    model = LabelModel(prior, np.full((size, 2), 0.5), shared_weights(linked), linked)
    for _ in range(6):
        for _ in range(rounds):
            for y, p in enumerate(((1 - post) * times, post * times)):
                model.says[:, y] = (p @ yes + prior_votes) / (p @ yes + p @ no + 2 * prior_votes)
            # a vote for toxic is right more often than not, whatever the agreement
            most = model.says[:, 1] * prior / (1 - prior) * (1 / LEAST_PRECISION - 1)
            model.says[:, 0] = np.minimum(model.says[:, 0], most)
            np.clip(model.says, 1e-6, 1 - 1e-6, out=model.says)
            before, post = post, model.posterior(votes)
            if np.abs(post - before).max(initial=0) < 1e-8:
                break
        model.correlation = class_correlations(votes, post, times)
        weight = shared_weights(model.correlation)
        rests = np.abs(weight - model.weight).max(initial=0) < 1e-3
        model.weight = weight
        post = model.posterior(votes)
        if rests:
            break
    return model


def fit_linear(row: np.ndarray, col: np.ndarray, size: int, target: np.ndarray, times: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft targets; the intercept is the last of ``size + 1``.

    Rows are sparse: entry ``(row, col)`` is one. Newton steps, solved by
    conjugate gradients.
    """
    n = len(target)
    row, col = np.r_[row, np.arange(n)], np.r_[col, np.full(n, size)]
    beta, penalty = np.zeros(size + 1), np.full(size + 1, ridge)
    penalty[-1] = 1e-6
    forth = lambda v: np.bincount(row, v[col], n)
    back = lambda v: np.bincount(col, v[row], size + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forth(beta), -30, 30)))
        residual = back(times * (target - p)) - penalty * beta
        curve = times * p * (1 - p) + 1e-9
        step, rest, aim = np.zeros(size + 1), residual.copy(), residual.copy()
        norm = rest @ rest
        for _ in range(50):
            if norm < 1e-12:
                break
            along = back(curve * forth(aim)) + penalty * aim
            by = norm / (aim @ along)
            step += by * aim
            rest -= by * along
            norm, before = rest @ rest, norm
            aim = rest + norm / before * aim
        beta += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def best_shift(z: np.ndarray, toxic: np.ndarray) -> float:
    """What to add to ``z`` so that its sign agrees with ``toxic`` most often.

    The cut is put half way between neighbours; among equal cuts the middle one.
    """
    if not len(z):
        return 0.0
    order = np.argsort(z, kind="stable")
    value, label = z[order], toxic[order] > 0.5
    right = np.r_[0, np.cumsum(~label)] + (label.sum() - np.r_[0, np.cumsum(label)])
    possible = np.r_[True, value[1:] > value[:-1], True]
    best = np.flatnonzero(possible & (right == right[possible].max()))
    at = best[len(best) // 2]
    low, high = value[max(at - 1, 0)], value[min(at, len(value) - 1)]
    if at == 0:
        low = high - 2
    if at == len(value):
        high = low + 2
    return float(-(low + high) / 2)


@dataclass
class ToxicityModel:
    """The linear classifier: a weight for each feature, and the intercept."""

    weights: dict[str, float]
    intercept: float

    def scorer(self):
        """A function from text to score; equal texts get equal scores."""
        weights, intercept, letters = self.weights, self.intercept, LETTERS
        words = {f for f in weights if not f.startswith("^")}
        starts = {n: {f[1:] for f in weights if f.startswith("^") and len(f) == n + 1} for n in PREFIXES}

        def score(text: str | None) -> float:
            own = set(letters.findall((text or "").lower()))
            hits = list(own & words)
            for n, known in starts.items():
                if known:
                    hits += ["^" + w for w in known & {w[:n] for w in own if len(w) > n}]
            z = intercept + sum(weights[f] for f in sorted(hits))
            z = z if own else min(z, NO_WORDS)
            return float(1 / (1 + np.exp(-min(max(z, -50.0), 50.0))))

        return score


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Propose the voters, fit the label model and train the classifier.

    Without toxic training rows, the fixed voters' model has a prior of 0.01,
    and the cut isn't moved. Without any training rows every score is low.
    """
    rows = as_table(training_rows(docs, labels, max_rows, id_col, text_col))
    size = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    n, n_toxic = int(size["n"]), float(size["t"] or 0)
    if not n:
        return ToxicityModel({}, -5.0)
    proposed = telling_features(feature_counts(rows), n_toxic, n - n_toxic, MAX_PROPOSED, LEAST_G2, LEAST_PRECISION) if 0 < n_toxic < n else []
    voters = deal_voters(proposed)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [cast_votes(t, voters) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["text"], batch["toxic"], pa.array(votes, pa.list_(pa.int8()))], ["text", "toxic", "votes"])

    voted = as_table(rows.mapInArrow(vote, "text string, toxic double, votes array<tinyint>"))
    kinds = voted.groupBy("votes").count().orderBy("votes").collect()  # at most max_rows
    table = np.array([r["votes"] for r in kinds], np.int8)
    model = fit_label_model(table, min(max(n_toxic / n, 0.01), 0.95), np.array([r["count"] for r in kinds], np.float64))
    judged = {tuple(r["votes"]): p for r, p in zip(kinds, model.posterior(table).tolist(), strict=True)}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            post = [judged[tuple(v)] for v in batch["votes"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["text"], pa.array(post, pa.float64()), batch["toxic"]], ["text", "toxic", "label"])

    soft = as_table(voted.mapInArrow(judge, "text string, toxic double, label double"))
    share = float(soft.agg(F.sum("toxic")).first()[0])
    known = telling_features(feature_counts(soft), share, n - share, MAX_FEATURES, LEAST_FEATURE_G2, 0.0) if 0 < share < n else []
    place = {f: i for i, f in enumerate(sorted(known))}

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sorted(place[f] for f in features(t) if f in place) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), batch["toxic"], batch["label"]], ["hits", "toxic", "label"])

    found = soft.mapInArrow(hit, "hits array<int>, toxic double, label double")
    alike = found.groupBy("hits").agg(F.count("*").alias("n"), F.avg("toxic").alias("post"), F.avg("label").alias("label"))
    alike = alike.orderBy("hits").collect()  # at most max_rows
    times = np.array([r["n"] for r in alike], np.float64)
    row = np.repeat(np.arange(len(alike)), [len(r["hits"]) for r in alike])
    col = np.array([c for r in alike for c in r["hits"]], np.int64)
    beta = fit_linear(row, col, len(place), np.round([r["post"] for r in alike], 9), times)
    z = beta[-1] + np.bincount(row, beta[col], len(alike))
    shift = best_shift(np.repeat(z, times.astype(int)), np.repeat([r["label"] for r in alike], times.astype(int))) if 0 < n_toxic < n else 0.0
    return ToxicityModel({f: float(beta[i]) for f, i in place.items()}, float(beta[-1]) + shift)


def with_scores(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a ``score`` column between 0 and 1."""
    score = model.scorer()

    @F.pandas_udf("double")
    def scored(texts):
        return texts.map(score, na_action=None).astype("float64")

    return docs.withColumn(name, scored(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null and empty texts have no words and get the score of a text without
    features, 0.27 at most. Rows that repeat an id are scored one by one, a null id counts as
    held out, an empty table gives no rows, and other columns are ignored. Ids
    are of any type that both tables can be joined on.
    """
    model = fit(docs, labels, max_rows, id_col=id_col, text_col=text_col)
    used = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_scores(used, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
