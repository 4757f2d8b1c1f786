"""An inverted index of documents: blocks of postings with their best scores.

A term's postings are cut into blocks of ascending documents. A block keeps its
documents with their lengths and frequencies, and the highest score that any of
them has for the term, so a search can leave out blocks that cannot reach a
query's best ``k``. Postings are dealt by ranges of documents, so the postings of
a term that all documents have are spread like any others, and no task sees a
whole term.

A search reads the blocks of the queries' terms only, each once for all queries,
and deals them by groups of ranges. In a group each query first scores the ranges
of its highest bounds, the sums of its terms' block maxima; of the others only
those are scored that can reach what ``k`` documents already have. The result is
exact. A group returns ``k`` rows a query, not a row for every document and query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions.text import tokens
from evigraph.operators.bounds import fits, text_tasks
from evigraph.sources.shared import as_table

#: Documents of a range (a block is a term's postings in one range), and ranges of a group.
RANGE_DOCS = 64
GROUP_RANGES = 128
#: Ranges that are scored for each query to find what the others must reach.
FIRST_RANGES = 4
#: Most rows of query terms that are sent to the tasks at once.
MAX_TERMS = 200_000
#: More than rounding can move a score.
MARGIN = 0.000002


@dataclass
class Postings:
    """``blocks``: ``term, part, best, docs, tfs, lens``; ``terms``: ``term, df``.

    ``docs`` are the block's documents, ``tfs`` and ``lens`` their frequencies
    and lengths, and ``best`` the largest of ``tf * (k1 + 1) / (tf + norm)``.
    """

    blocks: DataFrame
    terms: DataFrame
    n_docs: int
    mean_len: float
    k1: float
    b: float


def _saturation(tf: Column, length: Column, mean_len: float, k1: float, b: float) -> Column:
    """What a term of this frequency adds, before its rarity."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_len))


def build(docs: DataFrame, k1: float = 1.2, b: float = 0.75, range_docs: int = RANGE_DOCS, asked: DataFrame | None = None) -> Postings:
    """The index of ``docs`` (doc_id, text), as tables in the shared folder.

    With ``asked`` (text), only terms of those texts are indexed, for a search
    that is made once. Documents are dealt into ranges by a hash of the id. Null texts have no
    postings and no length, but count as documents; rows that repeat an id are
    one document of all their terms. Null ids are left out.
    """
    spark = docs.sparkSession
    rows, words = docs.where("doc_id IS NOT NULL").select("doc_id", "text"), tokens(F.col("text"))
    size = rows.agg(F.count("*").alias("n"), F.avg(F.size(words)).alias("mean"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n, mean = size["n"], size["mean"] or 1.0
    parts = max(1, -(-n // range_docs))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part")
    # Dealt by range once, as texts, documents and terms are grouped where they are, and by
    # number: a hash would give some tasks twice the ranges of others, the more the more tasks there are.
    tasks = text_tasks(spark, n, size["bytes"] or 0)
    task = F.expr(f"cast(part * {tasks} div {parts} as int)").alias("task")
    texts = rows.select(part, "doc_id", "text").select(task, "*").repartitionById(tasks, "task").select("task", "part", "doc_id", words.alias("w"))
    each = texts.select("task", "part", "doc_id", F.size("w").alias("len"), F.explode("w").alias("term"))
    wanted = None if asked is None else asked.select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    few = wanted is not None and fits(wanted, MAX_TERMS)
    if few:
        each = each.join(F.broadcast(wanted), "term", "left_semi")
    each = each.groupBy("task", "part", "doc_id", "term").agg(F.max("len").alias("len"), F.count("*").cast("int").alias("tf"))
    each = each.withColumn("s", _saturation(F.col("tf"), F.col("len"), mean, k1, b))
    listed = F.array_sort(F.collect_list(F.struct("doc_id", "tf", "len"))).alias("x")
    blocks = each.groupBy("task", "part", "term").agg(F.max("s").alias("best"), listed)
    blocks = blocks.select("term", "part", "best", F.col("x.doc_id").alias("docs"), F.col("x.tf").alias("tfs"), F.col("x.len").alias("lens"))
    if wanted is not None and not few:
        blocks = blocks.join(wanted, "term", "left_semi")
    if asked is None:
        # A file holds a range of terms, so a query's terms are read from few of them.
        blocks = blocks.repartitionByRange("term", "part").sortWithinPartitions("term", "part")
    stored = as_table(blocks)
    return Postings(stored, as_table(stored.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))), n, mean, k1, b)


def save(index: Postings, path: str) -> None:
    """Write an index to a folder of one's own."""
    index.blocks.write.parquet(f"{path}/blocks")
    index.terms.write.parquet(f"{path}/terms")
    rows = [(index.n_docs, index.mean_len, index.k1, index.b)]
    index.blocks.sparkSession.createDataFrame(rows, "n long, mean double, k1 double, b double").write.parquet(f"{path}/whole")


def load(spark: SparkSession, path: str) -> Postings:
    whole = spark.read.parquet(f"{path}/whole").first()
    return Postings(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms"), *whole)


def _searched(index: Postings, asked: dict[int, dict[str, float]], k: int, first: int):
    """Scores one group of ranges for all queries."""
    k1, b, mean_len = index.k1, index.b, index.mean_len

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("term").combine_chunks()
        begin = np.r_[0, np.cumsum(table["docs"].combine_chunks().value_lengths().to_numpy())]
        flat = lambda c: table[c].combine_chunks().flatten().to_numpy()
        docs, place = np.unique(flat("docs"), return_inverse=True)
        parts, part = np.unique(table["part"].to_numpy(), return_inverse=True)
        tf, size = flat("tfs").astype(np.float64), flat("lens").astype(np.float64)
        add = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean_len))
        part_of = np.repeat(part, np.diff(begin))
        names, at = np.unique(np.array(table["term"].to_pylist(), object), return_index=True)
        ends = np.r_[at, len(part)]
        rows_of = {n: slice(int(ends[i]), int(ends[i + 1])) for i, n in enumerate(names)}
        best = table["best"].to_numpy()
        found, n_scored = [], 0
        for query, terms in asked.items():
            own = [(rows_of[t], idf) for t, idf in terms.items() if t in rows_of]
            bound = np.zeros(len(parts))
            for rows, idf in own:
                bound[part[rows]] += idf * best[rows]
            total = score = np.zeros(len(docs))
            kth = 0.0
            order = np.argsort(-bound, kind="stable")
            for some in (order[:first], order[first:]):
                wanted = np.zeros(len(parts), bool)
                wanted[some] = bound[some] >= kth - MARGIN
                if not wanted.any():
                    continue
                for rows, idf in own:
                    held = slice(begin[rows.start], begin[rows.stop])
                    of = np.flatnonzero(wanted[part_of[held]]) + held.start
                    total[place[of]] += idf * add[of]
                    n_scored += len(of)
                score = np.round(total, 6)
                if np.count_nonzero(score) >= k:
                    kth = np.partition(score, len(score) - k)[len(score) - k]
            hit = np.flatnonzero((score >= kth) & (score > 0))
            hit = hit[np.lexsort((docs[hit], -score[hit]))][:k]
            found.append((np.full(len(hit), query), docs[hit], score[hit]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        out = pa.table({"query_id": pa.array(columns[0], pa.int64()), "doc_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})
        scored = pa.array([n_scored] * min(1, len(out)) + [0] * max(0, len(out) - 1), pa.int64())
        return out.append_column("scored", scored)

    return run


def search(index: Postings, queries: DataFrame, k: int, first: int = FIRST_RANGES, group_ranges: int = GROUP_RANGES, read: dict[str, int] | None = None) -> DataFrame:
    """The exact best ``k`` of each query: ``query_id, rank, doc_id, score``.

    Scores are rounded to six places; ties go to the smaller id. Queries of more
    than ``MAX_TERMS`` terms together are taken in blocks. If ``read`` is a
    dictionary it gets the postings of the queries' terms (``all``), a query
    each, and those that were scored (``scored``). Queries without known terms
    have no rows.
    """
    spark = index.blocks.sparkSession
    terms = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    idf = F.log(1 + (index.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = as_table(terms.where("query_id IS NOT NULL").distinct().join(index.terms, "term").select("query_id", "term", "df", idf.alias("idf")))
    blocks = -(-terms.count() // MAX_TERMS)
    schema = "query_id long, doc_id long, score double, scored long"
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        asked: dict[int, dict[str, float]] = {}
        for r in own.orderBy("query_id", "term").collect():  # about MAX_TERMS rows
            asked.setdefault(r["query_id"], {})[r["term"]] = r["idf"]
        if asked:
            matched = index.blocks.join(F.broadcast(own.select("term").distinct()), "term")
            matched = matched.withColumn("group", F.floor(F.col("part") / group_ranges).cast("int"))
            # By number and not by hash, which would give a task several groups to sort.
            groups = max(1, -(-index.n_docs // (RANGE_DOCS * group_ranges)))
            out = out.unionByName(matched.repartitionById(groups, "group").groupBy("group").applyInArrow(_searched(index, asked, k, first), schema))
    found = as_table(out)
    if read is not None:
        read["all"], read["scored"] = (int(x or 0) for x in (terms.agg(F.sum("df")).first()[0], found.agg(F.sum("scored")).first()[0]))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", "score")
