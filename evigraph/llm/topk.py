"""Exact top-k search by inner product over KD-trees, one tree per shard.

Vectors are dealt to shards by a top tree of median splits, so that a shard holds
vectors that lie together; the splits are taken from a bounded sample, and every
vector goes down them. A shard with too many rows, as of equal vectors, is split
again by a hash. Each shard has the tight box of its rows.

A query first searches its own shard. Its k-th best score so far then decides
where it goes next: only to shards whose box allows an inner product that is as
good. The best boxes are searched first, 4, then 16, then 64 and so on, and the
k-th score is carried from one round to the next.

Within a shard the KD-tree is walked best first. Every node has the tight box of
its rows; a query opens the node of its open ones whose box allows the highest
score, puts its two halves in its place or scores the rows of a leaf, and ends
when no open node reaches its k-th score. Many queries take their steps together.

Results are exact. In many dimensions boxes overlap, most of them have to be
opened, and the work is then that of a blocked scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import as_table, pieces

#: Components up to this size have products whose sums are exact in float64, for
#: up to 2**13 components. Vectors with larger ones are *wide*: Python's whole
#: numbers score them.
NARROW = 2.0**20
#: Most rows of the sample for the top tree, and most bytes of it.
SAMPLE_ROWS, SAMPLE_BYTES = 65536, 32 << 20
#: Bytes of a shard's vectors and of a block of queries, as float64, at most.
BLOCK_BYTES = 64 << 20
#: Shards that a query goes to in the first round; each round has four times more.
FIRST_SHARDS = 4
LEAST, MOST = -(2**63), 2**63 - 1


@dataclass
class Tree:
    """A KD-tree: the children of each node (-1 for a leaf), its box, and a
    leaf's row numbers."""

    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: list[np.ndarray]


def kd_tree(points: np.ndarray, leaf_rows: int) -> Tree:
    """A tree of median splits of the widest dimension.

    A node is a leaf if it has at most ``leaf_rows`` rows or if they are equal.
    """
    left, right, low, high, leaf = [-1], [-1], [None], [None], [np.arange(len(points))]
    at = 0
    while at < len(leaf):
        own = points[leaf[at]]
        low[at], high[at] = own.min(axis=0), own.max(axis=0)
        dim = int(np.argmax(high[at] - low[at]))
        if len(own) > leaf_rows and high[at][dim] > low[at][dim]:
            half = len(own) // 2
            order = np.argpartition(own[:, dim], half)
            left[at], right[at] = len(leaf), len(leaf) + 1
            for part in (order[:half], order[half:]):
                left.append(-1)
                right.append(-1)
                low.append(None)
                high.append(None)
                leaf.append(leaf[at][part])
            leaf[at] = None
        at += 1
    return Tree(np.array(left), np.array(right), np.stack(low), np.stack(high), leaf)


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest inner product of each query with any point of each box."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


class Best:
    """The k best of each query: higher score first, then the smaller id and row."""

    def __init__(self, size: int, k: int, kth: np.ndarray):
        self.score = np.full((size, k), -np.inf)
        self.ident = np.zeros((size, k), np.int64)
        self.row = np.full((size, k), -1, np.int64)
        self.floor = kth  # scores below are of no use

    def kth(self, who: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[who, -1], self.floor[who])

    def add(self, who: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        """Offer the same candidates to queries ``who``; -inf stands for none."""
        useful = (score >= self.kth(who)[:, None]) & (score > -np.inf)
        some = useful.any(axis=1)
        who, score = who[some], np.where(useful[some], score[some], -np.inf)
        if not len(who):
            return
        scores = np.c_[self.score[who], score]
        idents = np.c_[self.ident[who], np.broadcast_to(ident, score.shape)]
        rows = np.c_[self.row[who], np.broadcast_to(row, score.shape)]
        first = np.lexsort((rows, idents, -scores), axis=1)[:, : self.score.shape[1]]
        self.score[who], self.ident[who], self.row[who] = (np.take_along_axis(a, first, 1) for a in (scores, idents, rows))


def walk(tree: Tree, q: np.ndarray, q_row: np.ndarray, x: np.ndarray, x_id: np.ndarray, x_row: np.ndarray, best: Best) -> int:
    """Best-first traversal for all queries; returns how many leaves were opened,
    counted for each query."""
    open_ = np.full((len(q), len(tree.left)), -np.inf)
    open_[:, 0] = box_bounds(q, tree.low[:1], tree.high[:1])[:, 0]
    live, opened = np.arange(len(q)), 0
    while len(live):
        node = open_[live].argmax(axis=1)
        bound = open_[live, node]
        going = (bound >= best.kth(live)) & (bound > -np.inf)  # an equal score may have a smaller id
        live, node = live[going], node[going]
        open_[live, node] = -np.inf
        order = np.argsort(node, kind="stable")
        cuts = np.flatnonzero(np.diff(node[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            who, at = live[part], node[part[0]]
            if tree.left[at] >= 0:
                halves = [tree.left[at], tree.right[at]]
                open_[who[:, None], halves] = box_bounds(q[who], tree.low[halves], tree.high[halves])
                continue
            rows = tree.rows[at]
            opened += len(who)
            scores = q[who] @ x[rows].T
            scores[q_row[who][:, None] == x_row[rows][None, :]] = -np.inf
            best.add(who, scores, x_id[rows], x_row[rows])
    return opened


def search_shard(q: np.ndarray, q_row: np.ndarray, x: np.ndarray, x_id: np.ndarray, x_row: np.ndarray, k: int, kth: np.ndarray | None = None, leaf_rows: int = 256):
    """Best ``k`` rows of ``x`` for each row of ``q``, its own row excepted.

    ``kth`` is a score that each query has reached already; lower ones are left
    out. Returns the query's position, score, id and row number, and how many
    leaves were opened, counted for each query. Scores outside a long are
    replaced by its nearest end.
    """
    kth = np.full(len(q), -np.inf) if kth is None else kth.astype(float)
    wide_q, wide_x = (np.abs(a).max(axis=1, initial=0) > NARROW for a in (q, x))
    best, opened = Best(len(q), k, kth), 0
    near, narrow = np.flatnonzero(~wide_q), np.flatnonzero(~wide_x)
    if len(near) and len(narrow):
        tree = kd_tree(x[narrow], leaf_rows)
        step = max(1, (4 << 20) // len(tree.left))
        for i in range(0, len(near), step):
            part = near[i : i + step]
            own = Best(len(part), k, kth[part])
            opened += walk(tree, q[part], q_row[part], x[narrow], x_id[narrow], x_row[narrow], own)
            best.score[part], best.ident[part], best.row[part] = own.score, own.ident, own.row
    who, at = np.nonzero(best.score > -np.inf)
    out = [who, best.score[who, at].astype(np.int64), best.ident[who, at], best.row[who, at]]
    if wide_q.any() or wide_x.any():
        extra = _wide_scores(q, q_row, x, x_id, x_row, wide_q, wide_x, k)
        out = [np.concatenate(c) for c in zip(out, extra, strict=True)]
    return (*out, opened)


def _wide_scores(q, q_row, x, x_id, x_row, wide_q, wide_x, k):
    """Scores of pairs with a wide vector, in whole numbers of any size."""
    whole = lambda a: np.array([[int(v) for v in r] for r in a], object).reshape(a.shape)
    found = []
    points = {flag: (np.flatnonzero(wide_x | flag), None) for flag in (False, True)}
    points = {flag: (rows, whole(x[rows])) for flag, (rows, _) in points.items()}
    for i in range(len(q)):
        rows, values = points[bool(wide_q[i])]
        scores = (values * whole(q[i : i + 1])).sum(axis=1) if len(rows) else []
        kept = [(-min(max(s, LEAST), MOST), x_id[r], x_row[r]) for s, r in zip(scores, rows, strict=True) if x_row[r] != q_row[i]]
        found += [(i, -s, ident, row) for s, ident, row in sorted(kept)[:k]]
    return [np.array([f[c] for f in found], np.int64) for c in range(4)]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as float64; shorter ones are filled with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0) if flat.num_chunks else pa.array([], flat.type)
    lengths = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), dim))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def _points(table, dim: int) -> np.ndarray:
    """The vectors of rows with ``v`` (small whole numbers) or ``w`` (any)."""
    wide = table["w"].is_valid().to_numpy(zero_copy_only=False).astype(bool)
    out = _matrix(table["v"].fill_null([]), dim)
    if wide.any():
        out[wide] = _matrix(table["w"].fill_null([]), dim)[wide]
    return out


def top_splits(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and value of the median splits, node ``i`` above ``2i + 1`` and ``2i + 2``."""
    dims, cuts = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
    rows = {0: np.arange(len(sample))}
    for node in range(len(dims)):
        own = sample[rows.get(node, np.zeros(0, int))]
        if not len(own):
            continue
        dims[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        cuts[node] = np.median(own[:, dims[node]])
        above = own[:, dims[node]] >= cuts[node]
        rows[2 * node + 1], rows[2 * node + 2] = rows[node][~above], rows[node][above]
    return dims, cuts


def leaf_of(points: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The leaf of the top tree of each point."""
    node = np.zeros(len(points), np.int64)
    for _ in range(int(np.log2(len(dims) + 1))):
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] >= cuts[node])
    return node - len(dims)


def shards_to_visit(q: np.ndarray, home: np.ndarray, kth: np.ndarray, low: np.ndarray, high: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and shard of the shards number ``begin`` to ``end`` of each query's
    order, best box first, whose box reaches the k-th score. Its own shard has
    been searched. Vectors that are wide go wherever they may score."""
    bound = box_bounds(q, low, high)
    wide = (np.abs(q).max(axis=1, initial=0) > NARROW)[:, None] | (np.maximum(np.abs(low), np.abs(high)).max(axis=1, initial=0) > NARROW)[None, :]
    bound[wide] = np.inf
    bound[np.arange(len(q)), home] = -np.inf
    order = np.argsort(-bound, axis=1, kind="stable")[:, begin:end]
    reach = np.take_along_axis(bound, order, 1)
    who, at = np.nonzero((reach >= kth[:, None]) & (reach > -np.inf))
    return who, order[who, at]


FOUND = "query_row long, query_id long, vec_id long, row long, score long"
VECTOR = "id long, row long, v array<int>, w array<double>"


def _merged(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def exact_topk(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    scale: float = 64.0, shard_rows: int = 16384, block_rows: int = 16384, sent: list[int] | None = None,
) -> DataFrame:
    """The ``k`` rows of highest inner product for each query row.

    Components are turned into ``floor(scale * x)``. Returns ``query_id, rank,
    vec_id, score``; ties go to the smaller id, and a query's own row is left
    out. Rows that repeat an id are separate rows.

    Rows whose id or vector is null, or whose vector holds a null or a
    non-finite component, take no part. A shorter vector counts as filled with
    zeros; an empty one scores 0 with every row. Fewer than ``k`` candidates
    give fewer rows, and an empty table gives none. Other columns are ignored.
    Scores that a long can't hold become its nearest end and compare as such.
    ``shard_rows`` and ``block_rows`` are lowered for long vectors. If ``sent``
    is a list, the number of queries sent to other shards is added for each round.
    """
    spark = vectors.sparkSession
    x = F.col("v")
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        .where(F.col("id").isNotNull() & x.isNotNull())
        .where(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    )
    total = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    dim = max(1, total["d"] or 1)
    most = max(1, BLOCK_BYTES // (8 * dim))
    shard_rows, block_rows = min(shard_rows, most), min(block_rows, most)
    depth = max(0, int(np.ceil(np.log2(pieces(total["n"], shard_rows)))))
    size = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    picked = rows.select("v").where(F.rand(7) * total["n"] < size).limit(2 * size).toArrow() if depth else None
    with np.errstate(over="ignore"):
        dims, cuts = top_splits(np.floor(scale * _matrix(picked["v"], dim)), depth) if depth else (np.zeros(0, int), np.zeros(0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Beyond float64 the product is taken as the largest number.
            with np.errstate(over="ignore"):
                points = np.nan_to_num(np.floor(scale * _matrix(batch["v"], dim)))
            wide = pa.array(np.abs(points).max(axis=1, initial=0) > NARROW)
            small = _lists(np.where(np.abs(points) > NARROW, 0, points).astype(np.int32), pa.int32())
            none = pa.nulls(batch.num_rows, pa.list_(pa.int32()))
            large = _lists(points, pa.float64())
            columns = [
                batch["id"], batch["row"], pa.compute.if_else(wide, none, small),
                pa.compute.if_else(wide, large, pa.nulls(batch.num_rows, large.type)),
                batch["asks"], pa.array(leaf_of(points, dims, cuts)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "row", "v", "w", "asks", "leaf"])

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    placed = as_table(numbered.mapInArrow(place, f"{VECTOR}, asks boolean, leaf long"))
    counts = placed.groupBy("leaf").count()  # a row for each leaf of the top tree
    salt = F.pmod(F.xxhash64("row"), F.ceil(F.col("count") / shard_rows))
    shard = F.shiftleft("leaf", 24) + salt
    points = as_table(placed.join(F.broadcast(counts), "leaf").withColumn("shard", shard).drop("leaf", "count"))

    def at_home(table: pa.Table) -> pa.Table:
        own, asks = _points(table, dim), table["asks"].to_numpy(zero_copy_only=False).astype(bool)
        ids, row = table["id"].to_numpy(), table["row"].to_numpy()
        who, score, ident, found, _ = search_shard(own[asks], row[asks], own, ids, row, k)
        out = pa.table({"query_row": row[asks][who], "query_id": ids[asks][who], "vec_id": ident, "row": found, "score": score})
        n = len(who)
        out = out.append_column("shard", pa.array(np.full(n, table["shard"][0].as_py())))
        out = out.append_column("low", pa.nulls(n, pa.list_(pa.float64()))).append_column("high", pa.nulls(n, pa.list_(pa.float64())))
        box = {c: pa.nulls(1, pa.int64()) for c in ("query_row", "query_id", "vec_id", "row", "score")} | {"shard": table["shard"][:1]}
        box |= {"low": _lists(own.min(axis=0)[None], pa.float64()), "high": _lists(own.max(axis=0)[None], pa.float64())}
        return pa.concat_tables([out, pa.table(box)])

    home = as_table(points.groupBy("shard").applyInArrow(at_home, f"{FOUND}, shard long, low array<double>, high array<double>"))
    boxes = home.where("low IS NOT NULL").select("shard", "low", "high").orderBy("shard").toArrow()  # a row for each shard
    names = boxes["shard"].to_numpy()
    low, high = _matrix(boxes["low"], dim), _matrix(boxes["high"], dim)
    best = home.where("query_row IS NOT NULL").select("query_row", "query_id", "vec_id", "row", "score")

    def search(table: pa.Table) -> pa.Table:
        role = table["kth"].is_valid().to_numpy(zero_copy_only=False).astype(bool)
        own, ids, row = _points(table, dim), table["id"].to_numpy(), table["row"].to_numpy()
        kth = table["kth"].fill_null(0).to_numpy()[role]
        kth = np.where(kth == LEAST, -np.inf, kth)
        who, score, ident, found, _ = search_shard(own[role], row[role], own[~role], ids[~role], row[~role], k, kth)
        return pa.table({"query_row": row[role][who], "query_id": ids[role][who], "vec_id": ident, "row": found, "score": score})

    queries = points.where("asks").select("id", "row", "v", "w", "shard")
    begin, step = 0, FIRST_SHARDS
    while begin < len(names) - 1:
        end = begin + step

        def visit(batches: Iterator[pa.RecordBatch], begin=begin, end=end) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = _points(batch, dim)
                kth = batch["kth"].to_numpy(zero_copy_only=False)
                reached = np.where(kth == LEAST, -np.inf, kth)
                who, to = shards_to_visit(q, np.searchsorted(names, batch["shard"].to_numpy()), reached, low, high, begin, end)
                pick = pa.array(who)
                columns = [pa.array(names[to]), *(batch[c].take(pick) for c in ("id", "row", "v", "w", "kth"))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "id", "row", "v", "w", "kth"])

        full = best.groupBy(F.col("query_row").alias("row")).agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
        asked = queries.join(full.select("row", "kth"), "row", "left").withColumn("kth", F.coalesce("kth", F.lit(LEAST)))
        going = as_table(asked.select("id", "row", "v", "w", "shard", "kth").mapInArrow(visit, f"shard long, {VECTOR}, kth long"))
        visitors = going.groupBy("shard").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))  # a row for each shard
        if sent is not None:
            sent.append(going.count())
        blocks = F.broadcast(visitors)
        as_query = going.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
        as_point = points.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        own = ["shard", "block", "id", "row", "v", "w"]
        both = as_point.select(*own, F.lit(None).cast("long").alias("kth")).unionByName(as_query.select(*own, "kth"))
        found = both.groupBy("shard", "block").applyInArrow(search, FOUND)
        best = as_table(_merged(best.unionByName(found), k).drop("rank"))
        begin, step = end, step * 4
    return _merged(best, k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(vectors, F.col("vec_id") % 20 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
