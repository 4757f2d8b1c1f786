r"""Ranked lexical search over document-sharded postings with integer impacts.

Documents are dealt into shards as they are read. A shard is one row: its
vocabulary, and in compressed sparse rows (a pointer for each term) the documents
of each term with their impacts, small integers that are computed when the index
is written. What the impacts need of the whole corpus, the number of documents
and of terms, is counted before by one pass over the texts' bytes.

A search takes the queries term at a time: the impacts of a term, times its
weight, are added to a dense array with a place for each document of the shard.
The best of a shard are selected by partition, with all documents that tie with
the last, and those are ordered by score and id; a task keeps the best of its
shards and the tasks' best are merged. What a document gets depends on its own
shard only, so a lost task is one to run again.

Queries are taken in blocks of at most ``BLOCK_TERMS`` terms, each sent to the
tasks as it is; the index is read once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import as_table, documents, pieces

#: A term: a run of ASCII letters and digits and of all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8 that belong to terms, in lower case; all others are blanks.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
_IN_TERM = np.frombuffer(_FOLD, np.uint8) != 32

#: A shard ends with the document that reaches either.
SHARD_DOCS = 16384
SHARD_BYTES = 8 << 20
#: Terms of the queries that are searched for at once.
BLOCK_TERMS = 1 << 17

_SHARD = "ids array<long>, vocabulary binary, pointers binary, places binary, impacts binary"


@dataclass
class Index:
    """``shards``: a row each; ``n_docs``: documents with a term; ``n_terms``: all their terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents have a term, and how many terms there are."""
    for batch in batches:
        n = terms = 0
        for text in _texts(batch):
            inside = _IN_TERM[np.frombuffer(text, np.uint8)]
            own = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[:1].sum())
            n, terms = n + (own > 0), terms + own
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "terms": pa.array([terms], pa.int64())})


def shard_postings(ids: pa.Array, texts: list[bytes], n_docs: int, n_terms: int) -> dict[str, list]:
    """The columns of one shard's row."""
    split = [t.translate(_FOLD).split() for t in texts]
    lengths = np.array([len(x) for x in split], np.int64)
    # whole numbers of any size: 50 times length times documents can pass 64 bits
    norms = np.array([50 + 50 * int(n) * n_docs // max(n_terms, 1) for n in lengths], np.int64)
    words = np.empty(int(lengths.sum()), object)
    words[:] = [w for x in split for w in x]
    codes, vocabulary = pd.factorize(words)
    size = max(len(texts), 1)
    found, tf = np.unique(codes.astype(np.int64) * size + np.repeat(np.arange(len(texts)), lengths), return_counts=True)
    term, place = found // size, found % size
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * norms[place]) if len(tf) else tf
    pointers = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    return {
        "ids": [ids.to_pylist()], "vocabulary": [b" ".join(vocabulary)], "pointers": [pointers.astype(np.int64).tobytes()],
        "places": [place.astype(np.int32).tobytes()], "impacts": [impact.astype(np.int32).tobytes()],
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> Index:
    """Postings of all documents, as a table of shards in the shared folder.

    Null texts have no terms; they and rows of a null or repeated id are rows of
    the index like others. An empty table gives an index without rows. Other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    whole = rows.select("text").mapInArrow(_term_counts, "n long, terms long").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = whole["n"] or 0, whole["terms"] or 0
    kinds = {"ids": pa.list_(pa.int64()), "vocabulary": pa.binary(), "pointers": pa.binary(), "places": pa.binary(), "impacts": pa.binary()}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begin, held = _texts(batch), 0, 0
            for end, text in enumerate(texts, 1):
                held += len(text)
                if held >= shard_bytes or end - begin >= shard_docs or end == len(texts):
                    row = shard_postings(batch["id"].slice(begin, end - begin), texts[begin:end], n_docs, n_terms)
                    yield pa.RecordBatch.from_pydict({c: pa.array(row[c], kind) for c, kind in kinds.items()})
                    begin, held = end, 0

    return Index(as_table(rows.mapInArrow(build, _SHARD)), n_docs, n_terms)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, term``, each once."""
    terms = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER), F.lit(TERM), 0)
    rows = queries.select(F.col(id_col).cast("long").alias("item_id"), F.explode(terms).alias("term"))
    return rows.where("item_id IS NOT NULL").distinct()


def _frequencies(wanted: frozenset[bytes]):
    """The documents of each wanted term, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vocabulary, pointers in zip(batch["vocabulary"], batch["pointers"], strict=True):
                sizes = np.diff(np.frombuffer(pointers.as_py(), np.int64))
                terms = [(t, i) for i, t in enumerate(vocabulary.as_py().split(b" ")) if t in wanted]
                df = pa.array(sizes[[i for _, i in terms]] if terms else [], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t, _ in terms], pa.string()), df], ["term", "df"])

    return run


def best_first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, equal ones by ascending id."""
    at = np.arange(len(score))
    if len(score) > k:
        kth = score[np.argpartition(-score, k - 1)[k - 1]]
        at = np.flatnonzero(score >= kth)  # with all that tie with the last
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _searched(asked: dict[int, dict[bytes, int]], k: int):
    wanted = frozenset(t for terms in asked.values() for t in terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        best = dict.fromkeys(asked, none)
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda c, kind, row=row, batch=batch: np.frombuffer(batch[c][row].as_py(), kind)
                listed = batch["ids"][row].values
                null = listed.is_null().to_numpy(zero_copy_only=False).astype(bool)
                ids = listed.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                pointers, places, impacts = cell("pointers", np.int64), cell("places", np.int32), cell("impacts", np.int32)
                own = {t: i for i, t in enumerate(batch["vocabulary"][row].as_py().split(b" ")) if t in wanted}
                for item, terms in asked.items():
                    total = np.zeros(len(ids), np.int64)
                    for term, weight in terms.items():
                        if term in own:
                            at = slice(pointers[own[term]], pointers[own[term] + 1])
                            total[places[at]] += weight * impacts[at].astype(np.int64)
                    score, ident, odd = best[item]
                    least = score[-1] if len(score) == k else 1
                    hit = np.flatnonzero(total >= max(least, 1))
                    if len(hit):
                        score, ident, odd = np.r_[score, total[hit]], np.r_[ident, ids[hit]], np.r_[odd, null[hit]]
                        first = best_first(score, ident, k)
                        best[item] = (score[first], ident[first], odd[first])
        for item, (score, ident, odd) in best.items():
            if len(score):
                columns = [pa.array(np.full(len(score), item)), pa.array(ident, mask=odd), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    return run


def search(index: Index, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` highest-scoring documents of each query: ``item_id, rank, doc_id, score``.

    Rows that repeat a query's id are one query of all their terms; queries
    without an id or a term have no rows. Equal scores are ordered by id, null
    ids last; documents that repeat an id are ranked each. Only scores above 0
    are listed. No query or an empty index gives no rows.
    """
    spark = index.shards.sparkSession
    terms = as_table(query_terms(queries, id_col, text_col))
    blocks = pieces(terms.count(), block_terms)
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    ratio = F.lit(2 * index.n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    for block in range(blocks):
        part = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        wanted = frozenset(t.encode() for t in part.select("term").distinct().toPandas()["term"])
        if not wanted:
            continue
        df = index.shards.select("vocabulary", "pointers").mapInArrow(_frequencies(wanted), "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
        weighted = part.join(df, "term").select("item_id", "term", F.floor(1000 * F.log(ratio)).cast("long").alias("w")).where("w > 0")
        asked: dict[int, dict[bytes, int]] = {}
        for item, term, w in weighted.orderBy("item_id", "term").collect():  # bounded by block_terms
            asked.setdefault(item, {})[term.encode()] = w
        if asked:
            out = out.unionByName(as_table(index.shards.mapInArrow(_searched(asked, k), out.schema)))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_FOUND = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_FOUND} AS w FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({_FOUND}) AS term FROM benchmark WHERE item_id IS NOT NULL),
t AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, s GROUP BY term, n_docs),
r AS (SELECT item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN f USING (term), s GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""
