"""Packing documents into length buckets and token-budget batches.

Documents longer than ``max_len`` tokens are cut into pieces of ``max_len`` and
one remainder; nothing is dropped. The global histogram of piece lengths has
``max_len + 1`` bins at most, so it fits the driver whatever the corpus. Dynamic
programming over it finds the bucket boundaries with the least padding for a
given number of buckets. Batches are then formed inside each bucket: every piece
is padded to its bucket's boundary, and a batch holds as many as the token
budget allows.

Pieces are numbered within a bucket in three steps, so that no task sees a whole
bucket: each bucket is dealt over shards by a hash of the row, numbered there,
and the counts of shards, and of blocks of shards, give the offsets. Equal rows
are counted first and numbered together. The places depend on the rows alone and
not on how the input is partitioned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, as_table, documents, pieces

#: Shards whose counts are summed in one task.
SHARDS_OF_BLOCK = 4096


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding.

    ``lengths`` are distinct and ascending. Exact dynamic programming; of equal
    solutions the one with the earlier cuts is taken. No length, no bound.
    """
    size = len(lengths)
    if not size:
        return []
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    rows = np.r_[0, np.cumsum(counts)]
    tokens = np.r_[0, np.cumsum(counts * lengths)]
    # best[j]: least padding of the first j lengths with the buckets so far
    best = np.r_[0, lengths * rows[1:] - tokens[1:]]
    cuts = [np.zeros(size + 1, np.int64)]
    for _ in range(1, min(buckets, size)):
        new, cut = best.copy(), np.zeros(size + 1, np.int64)
        for j in range(1, size + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        best = new
        cuts.append(cut)
    bounds, j = [], size
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def token_pieces(docs: DataFrame, max_len: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of the documents: ``doc_id, piece, n_tokens, salt, copies``.

    ``salt`` is a hash of id, text and piece; ``copies`` rows have all of them.
    """
    total = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(F.col("total") / max_len) - 1, F.lit(0))
    return (
        docs.select(F.col(id_col).alias("doc_id"), total.alias("total"), F.xxhash64(F.col(text_col)).alias("text"))
        .select("doc_id", "total", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
        .select("doc_id", "piece", F.least(F.col("total") - F.col("piece") * max_len, F.lit(max_len)).cast("long").alias("n_tokens"), F.xxhash64("doc_id", "piece", "text").alias("salt"))
        .groupBy("doc_id", "piece", "n_tokens", "salt")
        .agg(F.count("*").alias("copies"))
    )


def pack(docs: DataFrame, max_len: int = 4096, buckets: int = 16, batch_tokens: int = 65536, shard_rows: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Batches of equally padded pieces.

    Returns ``doc_id, piece, n_tokens, bucket, bucket_len, batch, slot``:
    ``bucket`` counts from 0 by length, ``bucket_len`` is the padded length,
    ``batch`` counts from 0 within the bucket and ``slot`` within the batch. A
    batch holds ``batch_tokens // bucket_len`` pieces, and one at least.

    Tokens are words between ASCII white space. A null or empty text is one
    piece of 0 tokens. Pieces are numbered by shard, id and piece; repeated
    rows and null ids get places of their own, next to each other. An empty table gives no rows.
    Other columns are ignored.
    """
    rows = as_table(token_pieces(docs, max_len, id_col, text_col))  # read three times; texts are read once
    spread = rows.groupBy("n_tokens").agg(F.sum("copies").alias("n")).collect()  # max_len + 1 rows at most
    spread = sorted((r["n_tokens"], r["n"]) for r in spread)
    lengths, counts = np.array([x for x, _ in spread], np.int64), np.array([n for _, n in spread], np.int64)
    bounds = bucket_bounds(lengths, counts, buckets) or [0]
    shards = pieces(int(counts.sum()), shard_rows)
    bucket = F.lit(len(bounds) - 1)
    for number in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[number], F.lit(number)).otherwise(bucket)
    shard = F.pmod("salt", F.lit(shards))
    block = F.floor(F.col("shard") / SHARDS_OF_BLOCK)
    rows = rows.select("doc_id", "piece", "n_tokens", "salt", "copies", bucket.alias("bucket"), shard.alias("shard"))

    def sum_before(value: str, within: list[str], order: list) -> Column:
        earlier = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(earlier), F.lit(0).cast("long"))

    counts = rows.groupBy("bucket", "shard").agg(F.sum("copies").alias("n")).withColumn("block", block)
    blocks = counts.groupBy("bucket", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("bucket", "block", sum_before("n", ["bucket"], ["block"]).alias("base"))
    offsets = counts.withColumn("inside", sum_before("n", ["bucket", "block"], ["shard"])).join(blocks, ["bucket", "block"])
    offsets = offsets.select("bucket", "shard", (F.col("base") + F.col("inside")).alias("before"))
    order = [F.asc_nulls_last("doc_id"), F.col("piece"), F.col("n_tokens"), F.col("salt")]
    rows = rows.withColumn("nth", sum_before("copies", ["bucket", "shard"], order))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    length = F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("bucket") + 1).cast("long")
    room = F.greatest(F.floor(F.lit(batch_tokens) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1))
    place = (F.col("before") + F.col("nth") + F.col("copy")).cast("long")
    return (
        rows.join(offsets, ["bucket", "shard"])
        .select("doc_id", "piece", "n_tokens", "bucket", "before", "nth", copy)
        .withColumns({"bucket_len": length, "place": place})
        .select("doc_id", "piece", "n_tokens", "bucket", "bucket_len", F.floor(F.col("place") / room).alias("batch"), F.pmod(F.col("place"), room).alias("slot"))
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
