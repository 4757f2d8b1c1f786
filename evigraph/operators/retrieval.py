"""Vector, lexical and graph retrieval, their fusion, and evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.errors import IndexUnavailable
from evigraph.functions.text import tokens
from evigraph.operators.bounds import broadcast_if_small, dealt_texts, fits
from evigraph.sources.shared import as_table

#: Most queries that one batch search sends to every executor.
MAX_QUERIES = 4096
#: Cells of a matrix of scores (4 MB), whatever the queries and rows of a batch.
TILE_SCORES = 1 << 19
#: Most terms of all queries that are broadcast.
MAX_TERMS = 200_000


def _ranked(scores: DataFrame, k: int, ident: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), ident)
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def vector_search(queries: DataFrame, vectors: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """``query_id, vec_id, score``: cosine by matrix products, rounded to six places.

    Each task keeps a query's best ``k``, or those of ``least`` or more, and
    scores a batch in tiles of a bounded size. ``queries`` (query_id, q) is a stated set; a query's own row is left
    out, and of queries that repeat an id one is taken. Up to ``MAX_QUERIES`` go
    to every executor at once; more are dealt into blocks of about half that
    size, one after the other. Vectors without a length have no score.
    """
    asked = queries.select("query_id", "q").where("query_id IS NOT NULL AND q IS NOT NULL").dropDuplicates(["query_id"])
    count = asked.count()
    blocks = 1 if count <= MAX_QUERIES else -(-count // (MAX_QUERIES // 2))
    schema = "query_id long, vec_id long, score double"
    out = vectors.sparkSession.createDataFrame([], schema)
    for block in range(blocks if count else 0):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else asked
        rows = part.orderBy("query_id").collect()
        if rows:
            out = out.unionByName(vectors.select("vec_id", "embedding").mapInPandas(_search_block(rows, k, least), schema))
    return out


def tiles(n_queries: int, n_rows: int) -> Iterator[slice]:
    """Rows of a batch, so many at a time that a score matrix has about ``TILE_SCORES`` cells."""
    step = max(1, TILE_SCORES // max(n_queries, 1))
    for begin in range(0, n_rows, step):
        yield slice(begin, min(begin + step, n_rows))


class Best:
    """The best ``k`` of each query so far, by score and then the smaller id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.score = np.zeros((n_queries, 0))
        self.vec = np.zeros((n_queries, 0), np.int64)

    def add(self, score: np.ndarray, vec: np.ndarray) -> None:
        """Scores of all queries with the rows ``vec``; those that don't count are -inf."""
        score = np.hstack([self.score, score])
        vec = np.hstack([self.vec, np.broadcast_to(vec, (len(score), len(vec)))])
        if score.shape[1] > self.k:
            # All that reach the k-th score, so that ties go by the id.
            kth = np.partition(score, score.shape[1] - self.k, axis=1)[:, -self.k]
            wide = max(self.k, int((score >= kth[:, None]).sum(axis=1).max()))
            if wide < score.shape[1]:
                at = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
                score, vec = np.take_along_axis(score, at, 1), np.take_along_axis(vec, at, 1)
        order = np.lexsort((vec, -score), axis=1)[:, : self.k]
        self.score, self.vec = np.take_along_axis(score, order, 1), np.take_along_axis(vec, order, 1)

    def found(self, ids: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": np.repeat(ids, self.vec.shape[1]), "vec_id": self.vec.ravel(), "score": self.score.ravel()})
        return out[np.isfinite(out["score"])]


def _search_block(rows: list, k: int | None, least: float | None):
    ids = np.array([r["query_id"] for r in rows], np.int64)
    matrix = np.array([r["q"] for r in rows], np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None if k is None else Best(len(ids), k)
        for b in batches:
            b = b.dropna()
            for tile in tiles(len(ids), len(b)):
                part = b.iloc[tile]
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = np.round(matrix @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
                vec = part["vec_id"].to_numpy().astype(np.int64)
                score[(ids[:, None] == vec[None, :]) | ~np.isfinite(score)] = -np.inf
                if least is not None:
                    score[score < least] = -np.inf
                if best is not None:
                    best.add(score, vec)
                else:
                    q, at = np.nonzero(np.isfinite(score))
                    yield pd.DataFrame({"query_id": ids[q], "vec_id": vec[at], "score": score[q, at]})
        if best is not None:
            yield best.found(ids)

    return run


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The best ``k`` for each query, ties to the smaller id: ``query_id, rank, vec_id, score``."""
    return _ranked(vector_search(queries, vectors, k), k, "vec_id").select("query_id", "rank", "vec_id", "score")


def vector_range(queries: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """All of a score of ``least`` or more."""
    return vector_search(queries, vectors, least=least)


def vector_ann(queries: DataFrame, vectors: DataFrame, k: int, tables: int = 8, width: float = 1.0) -> DataFrame:
    """Approximate top-k by random projections; on the given tables at least 0.9 of the exact ones (tested).

    Rows that share a bucket with a query in one of the tables are scored. Queries
    with their buckets are sent to the tasks in blocks of ``MAX_QUERIES``, and a
    task keeps each query's best ``k``: candidates, which are most pairs where
    buckets are wide, are neither shuffled nor stored.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    lsh = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", numHashTables=tables, bucketLength=width, seed=7)
    base = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding", array_to_vector("embedding").alias("f"))
    model = lsh.fit(base)
    buckets = F.array(*[F.get(vector_to_array(F.get("h", F.lit(i))), F.lit(0)).cast("long") for i in range(tables)]).alias("h")
    hashed = model.transform(base).select("vec_id", "embedding", buckets)
    asked = queries.where("query_id IS NOT NULL AND q IS NOT NULL").select("query_id", "q", array_to_vector("q").alias("f"))
    asked = model.transform(asked).select("query_id", "q", buckets)
    asked = as_table(asked.dropDuplicates(["query_id"]))
    blocks = -(-asked.count() // MAX_QUERIES)
    schema = "query_id long, vec_id long, score double"
    out = vectors.sparkSession.createDataFrame([], schema)
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").collect()
        if rows:
            out = out.unionByName(hashed.mapInPandas(_search_buckets(rows, k), schema))
    return _ranked(out, k, "vec_id").select("query_id", "rank", "vec_id", "score")


def _search_buckets(rows: list, k: int):
    ids = np.array([r["query_id"] for r in rows], np.int64)
    matrix, own = np.array([r["q"] for r in rows], np.float64), np.array([r["h"] for r in rows], np.int64)
    squares = (matrix**2).sum(axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(ids), k)
        for b in batches:
            for tile in tiles(len(ids), len(b)):
                part = b.iloc[tile]
                x, h = np.stack(part["embedding"].to_numpy()).astype(np.float64), np.stack(part["h"].to_numpy())
                near = np.zeros((len(ids), len(x)), bool)
                for table in range(own.shape[1]):
                    near |= own[:, table, None] == h[None, :, table]
                # One less half of the squared distance, the cosine of unit vectors.
                score = np.round(1 - (squares[:, None] + (x**2).sum(axis=1)[None, :] - 2 * (matrix @ x.T)) / 2, 6)
                vec = part["vec_id"].to_numpy().astype(np.int64)
                # Within a distance of two, as the join had it.
                score[~near | (ids[:, None] == vec[None, :]) | ~(score > -1)] = -np.inf
                best.add(score, vec)
        yield best.found(ids)

    return run


def require_vectors(vectors: DataFrame | None, where: str = "") -> DataFrame:
    """The vectors, or error 3003 if there are none."""
    if vectors is None or "embedding" not in vectors.columns or vectors.isEmpty():
        raise IndexUnavailable(where)
    return vectors


def bm25(queries: DataFrame, docs: DataFrame, k: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, doc_id, score``: BM25 over lower-cased tokens, rounded to six places.

    Only terms of the queries are counted in the documents. Texts are dealt by
    document and their terms counted and scored where they are, in two passes:
    one for the counts of the whole corpus, which are small, and one for the
    scores, so that no table of all frequencies is stored or dealt again.
    ``k`` keeps the best.
    """
    spark = docs.sparkSession
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    words = dealt_texts(docs.select("doc_id", "text"), size["n"], size["bytes"] or 0, "doc_id").select("doc_id", tokens(F.col("text")).alias("w"))
    # The empty term stands for the document itself, with or without a hit.
    every = F.array_append(F.coalesce("w", F.array().cast("array<string>")), F.lit(""))
    wanted = terms.select("term").unionByName(spark.range(1).select(F.lit("").alias("term"))).distinct()
    each = words.select("doc_id", F.size("w").alias("len"), F.explode(every).alias("term"))
    few = fits(wanted, MAX_TERMS)
    if few:
        each = each.join(F.broadcast(wanted), "term", "left_semi")
    tf = each.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    if not few:
        tf = tf.join(wanted, "term", "left_semi")
    known = F.col("len").isNotNull()
    counts = as_table(tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"), F.sum(F.col("len") * F.col("tf")).alias("sum_len"), F.sum(F.when(known, F.col("tf"))).alias("n_len")))
    total = counts.where("term = ''").select("n", (F.col("sum_len") / F.col("n_len")).alias("avg_len"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = terms.join(counts.where("term <> ''").select("term", "df"), "term").crossJoin(F.broadcast(total)).select("query_id", "term", "avg_len", idf.alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    hits = tf.where("term <> ''").join(broadcast_if_small(as_table(asked), MAX_TERMS), "term")
    scores = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return scores if k is None else _ranked(scores, k, "doc_id").select("query_id", "rank", "doc_id", "score")


def fuse(channels: dict[str, DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank sums of ranked channels (query_id, rank, doc_id)."""
    parts = [df.select("query_id", "doc_id", (1.0 / (constant + F.col("rank"))).alias("s"), F.lit(name).alias("channel")) for name, df in channels.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    scores = union.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("channel"))
    return _ranked(scores, k, "doc_id").select("query_id", "rank", "doc_id", "score", "channel")


def graph_hits(seeds: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, doc_id, score``: documents that share entities with the
    query's seeds (query_id, doc_id), by how many.

    ``entities`` has ``doc_id, kind, entity``; two hops over the graph of
    documents and entities. Both joins are by entity or document, and a query's
    seeds are reduced to their distinct entities first.
    """
    of_seeds = seeds.select("query_id", "doc_id").join(entities, "doc_id").select("query_id", "kind", "entity").distinct()
    shared = of_seeds.join(entities.distinct(), ["kind", "entity"]).groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))
    return _ranked(shared, k, "doc_id").select("query_id", "rank", "doc_id", "score")


def rerank(hits: DataFrame, questions: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, doc_id, score``: hits in a new order, by the share of the
    question's distinct words that the document has.

    The share stands in for a cross-encoder's score; only hits are scored.
    """
    words = lambda c: F.array_distinct(tokens(F.col(c)))
    asked = questions.select("query_id", words("text").alias("asked"))
    found = hits.select("query_id", "doc_id").join(asked, "query_id").join(docs.select("doc_id", words("text").alias("words")), "doc_id")
    share = F.try_divide(F.size(F.array_intersect("asked", "words")), F.size("asked"))
    scored = found.select("query_id", "doc_id", F.round(F.coalesce(share, F.lit(0.0)), 6).alias("score"))
    return _ranked(scored, k, "doc_id").select("query_id", "rank", "doc_id", "score")


#: Our own rules for questions that are out of scope.
OUT_OF_SCOPE = r"(?i)\b(?:price (?:prediction|forecast)|predict|forecast|should i (?:buy|sell)|investment advice|real[- ]time quote)"


def declined(questions: DataFrame, hits: DataFrame, least: float) -> DataFrame:
    """``query_id, reason`` of the questions that aren't answered: ``out_of_scope``
    by their wording, or ``no_evidence`` if no hit has a score of ``least``."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    weak = F.col("best").isNull() | (F.col("best") < least)
    reason = F.when(F.col("text").rlike(OUT_OF_SCOPE), "out_of_scope").when(weak, "no_evidence")
    return questions.join(best, "query_id", "left").select("query_id", reason.alias("reason")).where("reason IS NOT NULL")


#: Characters of an excerpt before the word that it is cut around.
LEAD = 30


def evidence(hits: DataFrame, docs: DataFrame, width: int | None = 80, questions: DataFrame | None = None) -> DataFrame:
    """Ranked hits with their source's text, or an excerpt of ``width`` characters.

    With ``questions`` (query_id, text) the excerpt is cut around the first place
    of the question's longest word that the text has, of equal ones the first in
    order, and ``start`` tells where it begins, counted from 1. Texts without such
    a word, and all without ``questions``, are cut at their head.
    """
    found = hits.join(docs.select("doc_id", "source", "text"), "doc_id")
    start = F.lit(1).cast("long")
    if questions is not None:
        longest = F.array_sort(F.transform(F.array_distinct(tokens(F.col("text"))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
        found = found.join(questions.select("query_id", longest.alias("asked")), "query_id", "left").withColumn("low", F.lower("text"))
        places = F.transform("asked", lambda x: F.position(x["w"], F.col("low")))
        first = F.coalesce(F.get(F.filter(places, lambda n: n > 0), F.lit(0)), F.lit(1))
        start = F.greatest(first - LEAD, F.lit(1)).cast("long")
    excerpt = F.col("text") if width is None else F.substring(F.col("text"), start.cast("int"), F.lit(width))
    return found.select("query_id", "rank", "doc_id", "score", "channel", "source", start.alias("start"), excerpt.alias("excerpt"))


def history(conversations: DataFrame, conv_id: int) -> DataFrame:
    return conversations.where(F.col("conv_id") == conv_id).select("conv_id", "turn", "role", "text").orderBy("turn")
