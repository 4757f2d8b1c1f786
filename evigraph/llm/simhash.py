"""SimHash near-duplicates by tiled exact comparison.

Every text gets a 64-bit fingerprint of its word shingles. Equal fingerprints
are one class, so only distinct ones are compared. Those are dealt into groups
that can't miss a link: at a radius of r bits, two fingerprints cut into r + 1
blocks agree in one block at least, so each is put into the group of each of its
blocks. A group that is larger than a tile is cut into tiles by population count
and a salt, and pairs of tiles whose population counts differ beyond the radius
are skipped. What remains is compared exactly, in numpy, by exclusive-or and bit
counts. A task returns a spanning forest of its links, never its pairs, and
components are found by joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_table, checkpointed, documents, partitions
from .graph import connected_components

SEED = 42
#: Rows of a tile, and of the blocks in which a tile is compared.
TILE_ROWS, BLOCK_ROWS = 1024, 256


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle; A-Z lower-cased, words split at white space."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(b" ".join(tokens), SEED)], np.uint64)
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    begins = np.r_[0, ends[: len(tokens) - words]].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(begins, stops, strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 if there are none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    set_in = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""
    used = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(shingle_hashes(t, words)) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(own.view(np.int64))], ["doc_id", "fp"])

    return used.mapInArrow(run, "doc_id long, fp long")


def lowest_label(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(count)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def tile_blocks(x: np.ndarray, y: np.ndarray | None, radius: int, skip: Callable[[slice, slice], bool] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked rows of two tiles, or within one if ``y`` is None,
    block by block.

    Rows must be ascending by population count. Pairs of blocks whose population
    counts differ beyond the radius are left out, and so are those that ``skip``
    doesn't want.
    """
    own = y is None
    y = x if own else y
    px, py = np.bitwise_count(x).astype(int), np.bitwise_count(y).astype(int)
    for i in range(0, len(x), BLOCK_ROWS):
        a = x[i : i + BLOCK_ROWS]
        low, high = px[i], px[min(i + BLOCK_ROWS, len(x)) - 1]
        for j in range(i if own else 0, len(y), BLOCK_ROWS):
            if py[j] - high > radius:
                break
            if low - py[min(j + BLOCK_ROWS, len(y)) - 1] > radius:
                continue
            if skip is not None and skip(slice(i, i + BLOCK_ROWS), slice(j, j + BLOCK_ROWS)):
                continue
            p, q = np.nonzero(np.bitwise_count(a[:, None] ^ y[None, j : j + BLOCK_ROWS]) <= radius)
            if own and i == j:
                p, q = p[p < q], q[p < q]
            yield p + i, q + j


def tile_links(x: np.ndarray, y: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All that ``tile_blocks`` finds; for tiles of up to ``TILE_ROWS`` rows."""
    none = np.zeros(0, np.int64)
    left, right = zip((none, none), *tile_blocks(x, y, radius), strict=True)
    return np.concatenate(left), np.concatenate(right)


def by_group(keys: list[str], work: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, ...] | None], out: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Call ``work`` for each run of equal keys of a partition sorted by them.

    The group that a batch ends with is carried to the next, so a group is
    never cut; a task holds one batch and one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def flush(rows: dict[str, np.ndarray], last: bool) -> tuple[dict[str, np.ndarray] | None, list[tuple[np.ndarray, ...]]]:
            size = len(rows[keys[0]])
            new = np.zeros(size, bool)
            for k in keys:
                new[1:] |= rows[k][1:] != rows[k][:-1]
            cuts = np.r_[0, np.flatnonzero(new), size]
            end = len(cuts) - 1 if last else len(cuts) - 2
            found = []
            for a, b in zip(cuts[:end], cuts[1 : end + 1], strict=True):
                if b - a > 1 and (got := work({c: v[a:b] for c, v in rows.items()})) is not None:
                    found.append(got)
            return (None if last else {c: v[cuts[-2] :] for c, v in rows.items()}), found

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch[c].to_numpy(zero_copy_only=False) for c in batch.schema.names}
            if held is not None:
                rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()}
            held, found = flush(rows, False)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], out)
        if held is not None and len(held[keys[0]]):
            _, found = flush(held, True)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], out)

    return run


def block_of(fp: Column, radius: int) -> Column:
    """The fingerprint's blocks: an array of (number, value)."""
    blocks = radius + 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    values = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1).cast("long")).alias("value")) for i in range(blocks)]
    return F.array(*values)


def fingerprint_links(distinct: DataFrame, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links ``u, v`` of the ``fp`` column that connect what is within the radius.

    ``distinct`` has each fingerprint once. Links form a spanning forest of
    each pair of tiles, so there are fewer than rows compared.
    """
    rows = distinct.select("fp", F.bit_count("fp").alias("ones"), F.explode(block_of(F.col("fp"), radius)).alias("b")).select("b.block", "b.value", "ones", "fp")
    sizes = rows.groupBy("block", "value", "ones").count()
    large = (
        sizes.groupBy("block", "value")
        .agg(F.sum("count").alias("n"), F.array_sort(F.collect_list(F.struct("ones", F.ceil(F.col("count") / tile_rows).cast("int").alias("salts")))).alias("tiles"))
        .where(F.col("n") > tile_rows)
        .select("block", "value", "tiles")
    )
    rows = rows.join(large, ["block", "value"], "left")
    salts = F.element_at(F.filter("tiles", lambda t: t["ones"] == F.col("ones")), 1)["salts"]
    mine = F.struct(F.col("ones").alias("ones"), F.pmod(F.xxhash64("fp"), salts).cast("int").alias("salt"))
    near = F.filter("tiles", lambda t: F.abs(t["ones"] - F.col("ones")) <= radius)
    others = F.flatten(F.transform(near, lambda t: F.transform(F.sequence(F.lit(0), t["salts"] - 1), lambda s: F.struct(t["ones"].alias("ones"), s.alias("salt")))))
    pair = F.transform(others, lambda o: F.struct(F.least(o, F.col("mine")).alias("a"), F.greatest(o, F.col("mine")).alias("b")))
    whole = F.struct(F.lit(-1).alias("ones"), F.lit(0).alias("salt"))
    pairs = F.when(F.col("tiles").isNull(), F.array(F.struct(whole.alias("a"), whole.alias("b")))).otherwise(pair)
    mine = F.when(F.col("tiles").isNull(), whole).otherwise(mine)
    dealt = (
        rows.withColumn("mine", mine)
        .select("block", "value", "mine", "ones", "fp", F.explode(pairs).alias("p"))
        .select("block", "value", F.col("p.a.ones").alias("a1"), F.col("p.a.salt").alias("a2"), F.col("p.b.ones").alias("b1"), F.col("p.b.salt").alias("b2"), (F.col("mine") == F.col("p.a")).alias("first"), "ones", "fp")
    )
    keys = ["block", "value", "a1", "a2", "b1", "b2"]
    n = partitions(distinct.sparkSession)
    sorted_rows = dealt.repartition(n, *keys).sortWithinPartitions(*keys, "ones")

    def work(group: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        fp, first = group["fp"], group["first"].astype(bool)
        own = (group["a1"][0], group["a2"][0]) == (group["b1"][0], group["b2"][0])
        if own:
            a, b = tile_links(fp.view(np.uint64), None, radius)
        else:
            at, bt = np.flatnonzero(first), np.flatnonzero(~first)
            if not len(at) or not len(bt):
                return None
            a, b = tile_links(fp[at].view(np.uint64), fp[bt].view(np.uint64), radius)
            a, b = at[a], bt[b]
        if not len(a):
            return None
        label = lowest_label(len(fp), a, b)
        child = np.flatnonzero(label != np.arange(len(fp)))
        return fp[label[child]], fp[child]

    return sorted_rows.mapInArrow(by_group(keys, work, ["u", "v"]), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Texts whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest id that links reach, the row's own
    included. Null and empty texts have fingerprint zero and are linked like
    any other. A text of fewer words than a shingle is one shingle. Repeated
    rows keep a row each. Null ids are in their component but never name it,
    unless it has no other id. An empty table gives no rows. Other columns are
    ignored.
    """
    own = as_table(fingerprints(docs, words, id_col, text_col))
    classes = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    roots = connected_components(fingerprint_links(classes.select("fp"), radius))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = placed.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = placed.join(names, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


# --- similarity of shingle sets --------------------------------------------

#: Candidates differ in at most so many of 64 and of 128 bits. At a Jaccard
#: similarity of 0.8 about 10 and 19 differ, with deviations of 2.9 and 4.1.
WORD_RADIUS, BOTH_RADIUS = 18, 32
#: Rows of a tile, and shingles that a tile's rows may have together.
SET_TILE_ROWS, SET_TILE_SHINGLES = 16384, 8 << 20
#: Sets of up to so many shingles are also joined exactly: few shingles make noisy bits.
SMALL_SET = 64
#: Slots, a power of two, in which the shingles of small sets are counted.
SLOTS = 1 << 16
KEY = ["kn", "kd", "kt"]
#: A class: 128 bits of its documents' set of shingles.
SET = ["s1", "s2"]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    return np.unique(shingle_hashes(text, words))


def second_hash(hashes: np.ndarray) -> np.ndarray:
    """Hashes that are independent of the first for the second fingerprint."""
    x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(33))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``kn, kd, kt, text``: a key in order of id, null ids last, and text."""
    ident = F.col(id_col)
    return docs.select(ident.isNull().alias("kn"), F.coalesce(ident.cast("long"), F.lit(0).cast("long")).alias("kd"), F.xxhash64(F.col(text_col)).alias("kt"), F.col(text_col).alias("text"))


def _set_rows(rows: DataFrame, words: int) -> DataFrame:
    """``kn, kd, kt, fp, fp2, n, s1, s2``: two fingerprints, the number of
    shingles and a digest of the set of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"].to_pylist()]
            a = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            b = np.array([fingerprint(second_hash(s)) for s in sets], np.uint64).view(np.int64)
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            columns = [*(batch[k] for k in KEY), pa.array(a), pa.array(b), pa.array([len(s) for s in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(c)) for c in digest.T)], [*KEY, "fp", "fp2", "n", *SET])

    return rows.mapInArrow(run, "kn boolean, kd long, kt long, fp long, fp2 long, n int, s1 long, s2 long")


def candidate_blocks(group: dict[str, np.ndarray], similarity: float, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose fingerprints and sizes allow the similarity, block by block.

    Rows are of one tile or of two (``first`` tells which), ascending by the
    first fingerprint's population count. With ``label``, which may change
    between blocks, pairs of equal label are left out.
    """
    first = group["first"].astype(bool)
    own = (group["a1"][0], group["a2"][0]) == (group["b1"][0], group["b2"][0])
    a = np.arange(len(first)) if own else np.flatnonzero(first)
    b = a if own else np.flatnonzero(~first)
    fp, fp2, n = group["fp"].view(np.uint64), group["fp2"].view(np.uint64), group["n"]

    def joined(i: slice, j: slice) -> bool:
        return (label[a[i]] == label[a[i.start]]).all() and (label[b[j]] == label[a[i.start]]).all()

    for p, q in tile_blocks(fp[a], None if own else fp[b], WORD_RADIUS, None if label is None else joined):
        i, j = a[p], b[q]
        if label is not None:
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
        both = np.bitwise_count(fp[i] ^ fp[j]).astype(int) + np.bitwise_count(fp2[i] ^ fp2[j])
        ok = (both <= BOTH_RADIUS) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
        if ok.any():
            yield i[ok], j[ok]


def similar_forest(group: dict[str, np.ndarray], similarity: float) -> np.ndarray:
    """The smallest row that similar pairs of the group link each row to.

    The forest grows while blocks are compared: pairs that are connected already
    aren't looked at again, so a large cluster costs little more than one block
    of its rows against the others, and only a block's pairs are held at a time.
    """
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
    label = np.arange(len(sets))
    for i, j in candidate_blocks(group, similarity, label):
        here, at = np.unique(np.r_[i, j], return_inverse=True)
        ok = verified([sets[x] for x in here], at[: len(i)], at[len(i) :], similarity)
        if ok.any():
            child = np.flatnonzero(label != np.arange(len(label)))
            label[:] = lowest_label(len(label), np.r_[label[child], i[ok]], np.r_[child, j[ok]])
    return label


def verified(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float, rows: int = 256) -> np.ndarray:
    """Which pairs have the Jaccard similarity, by exact counts.

    Rows are put in order of their candidate components and worked off in
    blocks; a block pair without candidates costs nothing, one with them counts
    the shingles that both blocks have by a matrix product.
    """
    order = np.argsort(lowest_label(len(sets), a, b), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pa_, pb = place[a], place[b]
    p, q = np.minimum(pa_, pb), np.maximum(pa_, pb)
    cell = (p // rows) * (len(sets) // rows + 1) + q // rows
    by_cell = np.argsort(cell, kind="stable")
    ok = np.zeros(len(a), bool)

    def matrix(among: np.ndarray, columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(among), len(columns)), np.float32)
        for i, x in enumerate(among):
            own = sets[order[x]]
            at = np.searchsorted(columns, own)
            hit = at < len(columns)
            hit[hit] = columns[at[hit]] == own[hit]
            out[i, at[hit]] = 1
        return out

    for part in np.split(by_cell, np.flatnonzero(np.diff(cell[by_cell])) + 1) if len(a) else []:
        left, i = np.unique(p[part], return_inverse=True)
        right, j = np.unique(q[part], return_inverse=True)
        shared = np.intersect1d(np.concatenate([sets[order[x]] for x in left]), np.concatenate([sets[order[x]] for x in right]))
        common = np.zeros(len(part))
        for c in range(0, len(shared), 1 << 14):
            columns = shared[c : c + (1 << 14)]
            common += (matrix(left, columns) @ matrix(right, columns).T)[i, j]
        sizes = np.array([len(s) for s in sets])[order]
        union = sizes[p[part]] + sizes[q[part]] - common
        ok[part] = common >= similarity * np.maximum(union, 1)
    return ok


def set_prefix(shingles: np.ndarray, similarity: float, seen: np.ndarray | None = None) -> np.ndarray:
    """The first shingles in one order for all sets; similar sets have one of them in common.

    ``seen`` counts the shingles of all sets by their last bits. Shingles of
    rarer slots come first, then those of lesser hash, so what many texts have
    in common comes last and is in few prefixes.
    """
    n = len(shingles)
    if seen is not None:
        shingles = shingles[np.lexsort((shingles, seen[shingles & np.uint64(len(seen) - 1)]))]
    return shingles[: n - math.ceil(similarity * n - 1e-9) + 1]


def like_rows(own: list[np.ndarray], others: list[np.ndarray], similarity: float, wanted: Callable[[int], bool] = lambda i: True) -> Iterator[tuple[int, np.ndarray]]:
    """For each wanted set of ``own`` the positions of ``others`` that have the
    similarity, by exact counts over an inverted index of ``others``."""
    sizes = np.array([len(s) for s in others])
    values, value = np.unique(np.concatenate(others), return_inverse=True)
    holder = np.repeat(np.arange(len(others)), sizes)[np.argsort(value, kind="stable")]
    ends = np.cumsum(np.bincount(value, minlength=len(values)))
    begins = np.r_[0, ends[:-1]]
    for i, s in enumerate(own):
        if not wanted(i):
            continue
        at = np.searchsorted(values, s)
        hit = at < len(values)
        hit[hit] = values[at[hit]] == s[hit]
        held = [holder[begins[v] : ends[v]] for v in at[hit]]
        if held:
            common = np.bincount(np.concatenate(held), minlength=len(others))
            yield i, np.flatnonzero(common >= similarity * (len(s) + sizes - common))


def set_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets that have the similarity; for few sets."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, like in like_rows(sets, sets, similarity):
        like = like[like > i]
        left.append(np.full(len(like), i))
        right.append(like)
    return np.concatenate(left), np.concatenate(right)


def set_forest(sets: list[np.ndarray], first: np.ndarray, similarity: float) -> np.ndarray:
    """The smallest set that similar pairs link each set to.

    If ``first`` differs, sets of which it is true are compared with the others
    only. Rows whose partners they are connected to already are left out, and
    only one row's pairs are held at a time.
    """
    label = np.arange(len(sets))
    own = np.arange(len(sets)) if first.all() or not first.any() else np.flatnonzero(first)
    others = own if len(own) == len(sets) else np.flatnonzero(~first)
    apart = lambda i: bool((label[others] != label[own[i]]).any())
    for i, like in like_rows([sets[x] for x in own], [sets[x] for x in others], similarity, apart):
        met = np.unique(label[np.r_[own[i], others[like]]])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return label


def small_links(rows: DataFrame, kinds: DataFrame, words: int, similarity: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``u, v``: links among the classes of small sets, without candidates by bits.

    A prefix is taken in order of rarity, so a passage that very many texts
    have gathers only texts that hold little else. Sets are shipped only for
    shingles that two prefixes have; a shingle of more than ``tile_rows``
    prefixes is dealt by pairs of tiles. A task holds a pair of tiles and
    returns a forest. Rarity is counted in ``SLOTS`` slots over all small sets.
    """
    small = kinds.where((F.col("n") > 0) & (F.col("n") <= SMALL_SET)).select("class", "first.kn", "first.kd", "first.kt")
    texts = rows.join(small, KEY).dropDuplicates(["class"]).select("class", "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words).view(np.int64) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["class"], pa.array(sets, pa.list_(pa.int64()))], ["class", "shingles"])

    sets = as_table(texts.mapInArrow(to_sets, "class long, shingles array<long>"))
    seen = np.zeros(SLOTS, np.int64)
    slot = F.explode(F.transform("shingles", lambda x: x.bitwiseAND(F.lit(SLOTS - 1).cast("long")))).alias("slot")
    for r in sets.select(slot).groupBy("slot").count().collect():  # a row for each slot
        seen[r["slot"]] = r["count"]

    def to_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [set_prefix(np.array(x, np.int64).view(np.uint64), similarity, seen) for x in batch["shingles"].to_pylist()]
            at = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
            keys = np.concatenate([np.zeros(0, np.uint64), *heads]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch["class"].take(pa.array(at))], ["key", "class"])

    heads = as_table(sets.mapInArrow(to_heads, "key long, class long"))
    shared = heads.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles"))
    mine = F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")
    dealt = (
        heads.join(shared, "key")
        .select("key", "class", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        .select("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") <= F.col("other")).alias("first"), "class")
    )
    keys = ["key", "a", "b"]
    loaded = dealt.join(sets, "class").repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)

    def link(group: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
        held = [np.asarray(x, np.int64).view(np.uint64) for x in group["shingles"]]
        label = set_forest(held, group["first"].astype(bool), similarity)
        child = np.flatnonzero(label != np.arange(len(label)))
        return (group["class"][label[child]], group["class"][child]) if len(child) else None

    return loaded.mapInArrow(by_group(keys, link, ["u", "v"]), "u long, v long")


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``kn, kd, kt`` of every document and the key ``first`` of its class.

    Documents are linked if the Jaccard similarity of their sets of ``words``-
    word shingles is ``similarity`` or more, and a class is what links connect.
    Sets of up to ``SMALL_SET`` shingles are joined by their prefixes, which
    loses no pair. Candidates of larger ones come from the tiled comparison of
    two 64-bit fingerprints, which loses a few, and their sets are compared
    exactly. Documents of equal sets are compared once. Tiles hold documents of like size: sets
    whose sizes differ beyond the similarity can't be similar, so only tiles of
    equal or adjacent size bands are compared. Texts without a word are one
    class.

    The comparison is exhaustive within those bands, so it grows with the
    square of the documents; what keeps it small is that a comparison takes
    about a nanosecond.
    """
    rows = keyed(docs, id_col, text_col)
    own = as_table(_set_rows(rows, words))
    key = F.struct(*KEY)
    kinds = own.groupBy(*SET).agg(F.min(key).alias("first"), *[F.min(c).alias(c) for c in ("fp", "fp2", "n")])
    kinds = as_table(kinds.withColumn("class", F.monotonically_increasing_id()))  # fixed once it is written
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / float(-np.log(similarity))).cast("int")
    sized = kinds.select("class", "first", "fp", "fp2", "n", band.alias("band"), F.bit_count("fp").alias("ones"))
    counts = {r["band"]: (r["count"], r["most"]) for r in sized.groupBy("band").agg(F.count("*").alias("count"), F.max("n").alias("most")).collect()}  # a row for each power of 1.25
    salts = {b: -(-c // max(64, min(SET_TILE_ROWS, SET_TILE_SHINGLES // max(m, 1)))) for b, (c, m) in counts.items()}
    if not salts:
        return own.select(*KEY, key.alias("first"))
    salt_of = F.create_map(*[F.lit(x) for b, s in salts.items() for x in (b, s)])
    tiles = lambda b: F.transform(F.sequence(F.lit(0), F.coalesce(salt_of[b], F.lit(0)) - 1, F.lit(1)), lambda s: F.struct(b.alias("band"), s.cast("int").alias("salt")))
    near = F.flatten(F.transform(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1), lambda b: F.when(salt_of[b].isNotNull(), tiles(b)).otherwise(F.array().cast("array<struct<band:int,salt:int>>"))))
    mine = F.struct(F.col("band").alias("band"), F.pmod(F.xxhash64("class"), salt_of[F.col("band")]).cast("int").alias("salt"))
    dealt = (
        sized.withColumn("mine", mine)
        .withColumn("other", F.explode(near))
        .select(F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "class", "first", "fp", "fp2", "n", "ones")
        .select(F.col("a.band").alias("a1"), F.col("a.salt").alias("a2"), F.col("b.band").alias("b1"), F.col("b.salt").alias("b2"), (F.col("mine") == F.col("a")).alias("first_tile"), "class", "first", "fp", "fp2", "n", "ones")
    )
    keys = ["a1", "a2", "b1", "b2"]
    parts = partitions(docs.sparkSession)
    ordered = dealt.select(*keys, F.col("first_tile").alias("first"), "class", "fp", "fp2", "n", "ones").repartition(parts, *keys).sortWithinPartitions(*keys, "ones")

    def find(group: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
        met = np.zeros(len(group["class"]), bool)
        for i, j in candidate_blocks(group, similarity):
            met[i] = met[j] = True
        return tuple(group[c][met] for c in (*keys, "first", "class", "fp", "fp2", "n", "ones")) if met.any() else None

    names = [*keys, "first", "class", "fp", "fp2", "n", "ones"]
    found = ordered.mapInArrow(by_group(keys, find, names), "a1 int, a2 int, b1 int, b2 int, first boolean, class long, fp long, fp2 long, n int, ones int")
    found = as_table(found)
    # the sets of candidates only, one document for each class
    wanted = kinds.join(found.select("class").distinct(), "class").select("class", "first.kn", "first.kd", "first.kt")
    texts = rows.join(wanted, KEY).dropDuplicates(["class"]).select("class", "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["class"], pa.array([shingle_set(t, words).tobytes() for t in batch["text"].to_pylist()], pa.binary())], ["class", "shingles"])

    sets = texts.mapInArrow(to_sets, "class long, shingles binary")
    loaded = found.join(sets, "class").repartition(parts, *keys).sortWithinPartitions(*keys, "ones")

    def verify(group: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
        label = similar_forest(group, similarity)
        child = np.flatnonzero(label != np.arange(len(label)))
        return (group["class"][label[child]], group["class"][child]) if len(child) else None

    links = loaded.mapInArrow(by_group(keys, verify, ["u", "v"]), "u long, v long")
    roots = connected_components(links.unionByName(small_links(rows, kinds, words, similarity)))
    placed = kinds.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("first"))
    named = placed.drop("first").join(firsts, "root").select(*SET, "first")
    return own.join(named, SET).select(*KEY, "first")


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class of similar ones.

    The first by id stays (null ids last, then by a hash of the text), with all
    its columns. Rows that repeat an id and a text are one document. Null and
    empty texts are one class. An empty table gives no rows.
    """
    own = docs.columns
    hidden = docs.select(*[F.col(c).alias(f"x{i}") for i, c in enumerate(own)])
    ident, text = f"x{own.index(id_col)}", f"x{own.index(text_col)}"
    classes = similar_classes(docs, words, similarity, id_col, text_col)
    firsts = classes.select("first.*").distinct()
    with_key = hidden.select("*", F.col(ident).isNull().alias("kn"), F.coalesce(F.col(ident).cast("long"), F.lit(0).cast("long")).alias("kd"), F.xxhash64(F.col(text)).alias("kt"))
    kept = with_key.join(firsts, KEY, "left_semi").dropDuplicates(KEY)
    return kept.select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(own)])
