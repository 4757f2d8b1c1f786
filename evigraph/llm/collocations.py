r"""Phrase collocations, mined from compressed position bitmaps.

Texts are dealt into shards of one language as they are read. A shard numbers the
positions of its words, with one position left out between pieces, and keeps for
each word a bitmap of its positions: of the blocks of 16 positions only those
that have the word. The shards are a table that is written once.

A phrase's bitmap, shifted by one and intersected with the bitmaps of the words in
the same blocks, gives the bitmaps of the phrases that are longer by a word; their
bits are the occurrences, and the gaps keep them within pieces. Phrases are
extended depth first, a bounded group of first words at a time, so what a task
holds doesn't grow with the phrases. Bits are summed over the shards.

No phrase is more frequent than its parts. The frequent words, and then the frequent
pairs, are therefore found first, by hashes whose counts are summed over all
shards, and are sent to the tasks as bit arrays of a bounded size. A task sums the
counts of several shards and ships them packed, cut by ranges of the hashes: sorted
hashes as differences, phrases that begin alike compressed together. Both a shared
hash and a shared bit only let more phrases through: what is kept in the end is
counted by its words, exactly, however full the bit arrays are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.sources.shared import new_path

from ._common import as_table, documents, pieces
from .suffix_dedup import give_back_memory

LEAST = 30
LONGEST = 4
TOP = 2000
#: Hundredths of a phrase's occurrences that, in a longer candidate, make it redundant.
WITHIN = 80
SCALE = 2_000_000

#: Positions of a block, words of a shard, and bitmap blocks of a group of first words.
BLOCK = 16
SHARD_WORDS = 1 << 18
GROUP_BLOCKS = 1 << 15
#: Row groups of the shards' table: their size is looked at after each row, since
#: rows are large and tasks are dealt whole groups.
ROW_GROUPS = {"compression": "zstd", "parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: Bits of a bit array: 16 for each entry, within these powers of two (64 MB at most).
LEAST_BITS, MOST_BITS = 20, 29
#: Counts that a task sums before it packs them, and words of the corpus whose counts a piece gets.
MERGED_ROWS, PIECE_WORDS = 1 << 20, 1 << 21
#: Bits of the hashes that are counted: 16 values for each word of the corpus, within these.
LEAST_SPACE, MOST_SPACE = 32, 60
#: Tasks that rows of a single word that is part of phrases are dealt over.
SALTS = 8

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Lower case, separators as full stops, tabs as blanks.
_FOLD = bytes(46 if b in _SEPARATORS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)

_KINDS = {
    "lang": pa.string(), "n": pa.int64(), "positions": pa.int64(), "words": pa.binary(), "hashes": pa.binary(), "counts": pa.binary(),
    "pointers": pa.binary(), "blocks": pa.binary(), "bits": pa.binary(),
}
_SHARD = "lang string, n long, positions long, words binary, hashes binary, counts binary, pointers binary, blocks binary, bits binary"


def position_bitmaps(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pointers, blocks and bits of each code's positions; negative codes have none."""
    at = np.flatnonzero(codes >= 0)
    order = at[np.argsort(codes[at], kind="stable")]
    code, block = codes[order].astype(np.int64), order // BLOCK
    bit = (1 << (order % BLOCK)).astype(np.uint16)
    begin = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(block) != 0)]) if len(order) else order
    bits = np.bitwise_or.reduceat(bit, begin) if len(order) else bit
    pointers = np.searchsorted(code[begin], np.arange((int(code[-1]) if len(order) else -1) + 2))
    return pointers.astype(np.int64), block[begin].astype(np.int32), bits


def _shard(lang: str, vocabulary: dict[bytes, int], parts: list[np.ndarray]) -> pa.RecordBatch:
    """A shard's row; the stop is the first of the vocabulary."""
    codes = np.concatenate(parts) - 1
    words = list(vocabulary)[1:]
    pointers, blocks, bits = position_bitmaps(codes)
    seed = xxhash.xxh64_intdigest(lang.encode())
    hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)
    counts = np.bincount(codes[codes >= 0], minlength=len(words)).astype(np.int64)
    row = {
        "lang": lang, "n": int(counts.sum()), "positions": len(codes), "words": b" ".join(words), "hashes": hashes.tobytes(),
        "counts": counts.tobytes(), "pointers": pointers.tobytes(), "blocks": blocks.tobytes(), "bits": bits.tobytes(),
    }
    return pa.RecordBatch.from_pydict({c: pa.array([row[c]], kind) for c, kind in _KINDS.items()})


def _sharded(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                words = text.as_py().translate(_FOLD).replace(b".", b" . ").split()
                vocabulary, parts = held.setdefault(lang, ({b".": 0}, []))
                parts.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in [*words, b"."]], np.int32))
                sizes[lang] = sizes.get(lang, 0) + len(words) + 1
                while sum(sizes.values()) >= shard_words:
                    largest = max(sizes, key=sizes.__getitem__)
                    del sizes[largest]
                    yield _shard(largest, *held.pop(largest))
                    give_back_memory()
        for lang in list(held):
            yield _shard(lang, *held.pop(lang))
        give_back_memory()

    return run


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    with np.errstate(over="ignore"):
        x = (a * _MIX) ^ (b + (a >> np.uint64(29)))
        x = (x ^ (x >> np.uint64(32))) * _MIX
        return x ^ (x >> np.uint64(29))


class Bits:
    """Which hashes may be meant: a bit for each value of their first bits."""

    def __init__(self, power: int, data: np.ndarray):
        self.power, self.data = power, data

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(64 - self.power)).astype(np.int64)
        return (self.data[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers as planes of their bytes, compressed: planes of small numbers are zeros."""
    return pa.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _whole(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n).T.copy().view("<u8").ravel()


def _sums(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, in order, with its sum."""
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    begin = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(order) else order
    return hashes[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def _packed(rows: Iterator[tuple[np.ndarray, np.ndarray]], power: int, n_pieces: int) -> Iterator[pa.RecordBatch]:
    """Counts by hash (``piece, n, keys, counts``): so many at a time are summed and
    cut by ranges of the hashes' first bits. Sorted hashes are kept as differences."""
    bounds = np.array([(i << power) // n_pieces for i in range(1, n_pieces)], np.uint64)

    def flushed() -> pa.RecordBatch:
        h, n = _sums(np.concatenate([x for x, _ in held]) >> np.uint64(64 - power), np.concatenate([x for _, x in held]))
        ends = np.r_[0, np.searchsorted(h, bounds), len(h)]
        own = [(i, slice(int(x), int(y))) for i, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if x < y]
        columns = [[i for i, _ in own], [x.stop - x.start for _, x in own], [_planes(np.diff(h[x], prepend=np.uint64(0))) for _, x in own], [_planes(n[x]) for _, x in own]]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["piece", "n", "keys", "counts"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for hashes, counts in rows:
        held.append((hashes, counts))
        if sum(len(x) for x, _ in held) >= MERGED_ROWS:
            yield flushed()
            held.clear()
            give_back_memory()
    if held:
        yield flushed()


_PACKED = "piece int, n int, keys binary, counts binary"


def _often(least: int):
    """The hashes of a piece that are counted ``least`` times or more."""

    def run(table: pa.Table) -> pa.Table:
        columns = [table[c].to_pylist() for c in ("n", "keys", "counts")]
        hashes = np.concatenate([np.cumsum(_whole(keys, n)) for n, keys, _ in zip(*columns, strict=True)])
        counts = np.concatenate([_whole(data, n) for n, _, data in zip(*columns, strict=True)])
        hashes, counts = _sums(hashes, counts)
        out = pa.table({"h": pa.array(hashes[counts >= least].astype(np.int64))})
        give_back_memory()
        return out

    return run


def _frequent(packed: DataFrame, least: int, space: int, most_bits: int) -> Bits:
    """The hashes of ``space`` bits whose counts sum to ``least`` or more."""
    found = as_table(packed.groupBy("piece").applyInArrow(_often(least), "h long"))
    power = int(np.clip(np.ceil(np.log2(16 * found.count() + 1)), LEAST_BITS, most_bits))
    slot = F.shiftrightunsigned("h", space - power)
    parts = found.groupBy(F.shiftright(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits"))
    data = np.zeros((1 << max(power - 15, 0), 4096), np.uint8)
    for row in parts.toLocalIterator():  # 64 MB at most, whatever the corpus
        data[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return Bits(power, data.ravel())


class Shard:
    """A shard's bitmaps of the words that may be frequent, by word and by block."""

    def __init__(self, batch: pa.RecordBatch, row: int, words: Bits):
        cell = lambda c, kind: np.frombuffer(batch[c][row].as_py(), kind)
        self.lang = batch["lang"][row].as_py()
        self.counts, pointers = cell("counts", np.int64), cell("pointers", np.int64)
        hashes = cell("hashes", np.uint64)
        self.names = batch["words"][row].as_py().split(b" ")
        mine = words.has(hashes)
        word = np.repeat(np.arange(len(hashes)), np.diff(pointers)) if len(hashes) else np.zeros(0, np.int64)
        of_mine = mine[word]
        self.word, self.block, self.bits = word[of_mine], cell("blocks", np.int32)[of_mine].astype(np.int64), cell("bits", np.uint16)[of_mine]
        self.hashes, self.size = hashes, max(len(hashes), 1)
        self.n_blocks = -(-batch["positions"][row].as_py() // BLOCK)
        order = np.argsort(self.block, kind="stable")
        self.by_block = self.word[order], self.bits[order]
        self.first = np.searchsorted(self.block[order], np.arange(self.n_blocks + 1))

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """First words with their blocks and bits, so many at a time."""
        begin, starts = 0, np.flatnonzero(np.r_[True, np.diff(self.word) != 0]) if len(self.word) else []
        for end in [*starts[1:], len(self.word)] if len(self.word) else []:
            if end - begin >= GROUP_BLOCKS or end == len(self.word):
                yield self.word[begin:end], self.block[begin:end], self.bits[begin:end]
                begin = end

    def extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrase, next word, block and bits: each phrase's bitmap shifted by a
        position and intersected with those of all words in its blocks."""
        over = np.flatnonzero(bits >> np.uint16(BLOCK - 1))
        key = np.r_[phrase, phrase[over]] * (self.n_blocks + 1) + np.r_[block, block[over] + 1]
        moved = np.r_[bits << np.uint16(1), np.ones(len(over), np.uint16)]
        order = np.argsort(key, kind="stable")
        key, moved = key[order], moved[order]
        begin = np.flatnonzero(np.r_[True, np.diff(key) != 0]) if len(key) else order
        key, moved = key[begin], np.bitwise_or.reduceat(moved, begin) if len(begin) else moved
        phrase, block = key // (self.n_blocks + 1), key % (self.n_blocks + 1)
        inside = (moved != 0) & (block < self.n_blocks)
        phrase, block, moved = phrase[inside], block[inside], moved[inside]
        n = self.first[block + 1] - self.first[block]
        source = np.repeat(np.arange(len(block)), n)
        at = np.arange(len(source)) + np.repeat(self.first[block] - np.r_[0, np.cumsum(n)[:-1]], n) if len(n) else source
        both = moved[source] & self.by_block[1][at]
        hit = np.flatnonzero(both)
        source, at = source[hit], at[hit]
        return phrase[source], self.by_block[0][at], block[source], both[hit]

    def counted(self, phrase: np.ndarray, word: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each phrase and next word once, their occurrences, and which one each bitmap block belongs to."""
        longer, inverse = np.unique(phrase * self.size + word, return_inverse=True)
        n = np.bincount(inverse, weights=np.bitwise_count(bits), minlength=len(longer)).astype(np.int64)
        return longer // self.size, longer % self.size, n, inverse


def _word_counts(space: int, n_pieces: int):
    """Occurrences of the words, by their hashes."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for hashes, counts in zip(batch["hashes"], batch["counts"], strict=True):
                yield np.frombuffer(hashes.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.int64)

    return lambda batches: _packed(counted(batches), space, n_pieces)


def _pair_counts(words: Bits, space: int, n_pieces: int):
    """Occurrences of the pairs of frequent words, by the pairs' hashes."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch, row, words)
                for root, block, bits in shard.groups():
                    first, word, _, both = shard.extended(root, block, bits)
                    first, word, n, _ = shard.counted(first, word, both)
                    yield pair_hash(shard.hashes[first], shard.hashes[word]), n
                del shard
                give_back_memory()

    return lambda batches: _packed(counted(batches), space, n_pieces)


_PHRASES = "lang string, piece int, n int, texts binary, lengths binary, counts binary"


class Phrases:
    """Phrases of one language with their occurrences, until they are summed and packed.

    They are put in the order of the hashes of their first two words and of all
    words: equal ones meet, and ones that begin alike are compressed together.
    Only equal words are summed; phrases that share a hash stay apart.
    """

    def __init__(self, lang: str):
        self.lang, self.rows, self.size = lang, [], 0

    def add(self, shard: Shard, names: pa.Array, phrases: np.ndarray, n: np.ndarray) -> None:
        whole = shard.hashes[phrases[:, 0]]
        begin = whole
        for i in range(1, phrases.shape[1]):
            whole = pair_hash(whole, shard.hashes[phrases[:, i]])
            begin = whole if i == 1 else begin
        words = [names.take(pa.array(phrases[:, i])) for i in range(phrases.shape[1])]
        text = pc.binary_join_element_wise(*words, b" ") if len(words) > 1 else words[0]
        self.rows.append((begin, whole, text, n))
        self.size += len(n) + text.nbytes // 64

    def packed(self, n_pieces: int) -> pa.RecordBatch:
        begin, whole, n = (np.concatenate([r[i] for r in self.rows]) for i in (0, 1, 3))
        order = np.lexsort((whole, begin))
        text = pa.concat_arrays([r[2] for r in self.rows]).take(pa.array(order))
        begin, whole = begin[order], whole[order]
        other = (whole[1:] != whole[:-1]) | (begin[1:] != begin[:-1]) | pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, other])
        n, text = np.add.reduceat(n[order], first), text.take(pa.array(first))
        piece = ((begin[first] >> np.uint64(32)) * np.uint64(n_pieces) >> np.uint64(32)).astype(np.int64)
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
        data = text.buffers()[2]
        columns: list[list] = [[] for _ in range(6)]
        ends = np.r_[np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]), len(piece)]
        for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            texts = pa.compress(data[int(offsets[x]) : int(offsets[y])], "zstd", asbytes=True)
            for c, value in zip(columns, (self.lang, int(piece[x]), y - x, texts, _planes(np.diff(offsets[x : y + 1])), _planes(n[x:y])), strict=True):
                c.append(value)
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["lang", "piece", "n", "texts", "lengths", "counts"])


def _phrase_counts(words: Bits, pairs: Bits, longest: int, n_pieces: int):
    """Occurrences of the phrases of which all words and pairs may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Phrases] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch, row, words)
                names = pa.array(shard.names, pa.binary())
                own = held.setdefault(shard.lang, Phrases(shard.lang))
                present = np.unique(shard.word)
                if len(present):
                    own.add(shard, names, present[:, None], shard.counts[present])
                for phrase, block, bits in shard.groups():
                    kept = np.arange(shard.size)[:, None]  # the words of each phrase number
                    for _ in range(longest - 1):
                        old, word, block, bits = shard.extended(phrase, block, bits)
                        likely = pairs.has(pair_hash(shard.hashes[kept[old, -1]], shard.hashes[word]))
                        old, word, block, bits = old[likely], word[likely], block[likely], bits[likely]
                        if not len(old):
                            break
                        first, last, n, phrase = shard.counted(old, word, bits)
                        kept = np.column_stack([kept[first], last])
                        own.add(shard, names, kept, n)
                    if sum(x.size for x in held.values()) >= MERGED_ROWS:
                        largest = max(held.values(), key=lambda x: x.size)
                        yield held.pop(largest.lang).packed(n_pieces)
                        own = held.setdefault(shard.lang, Phrases(shard.lang))
                        give_back_memory()
                del shard
                give_back_memory()
        yield from (x.packed(n_pieces) for x in held.values() if x.rows)

    return run


def _frequent_phrases(least: int):
    """The phrases of one piece and language that occur ``least`` times or more, by their words."""

    def run(table: pa.Table) -> pa.Table:
        texts, counts = [], []
        for n, data, lengths, own in zip(*(table[c].to_pylist() for c in ("n", "texts", "lengths", "counts")), strict=True):
            offsets = np.r_[0, np.cumsum(_whole(lengths, n).astype(np.int64))].astype(np.int32)
            texts.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.decompress(data, int(offsets[-1]), "zstd")]))
            counts.append(_whole(own, n).astype(np.int64))
        summed = pa.table({"phrase": pa.chunked_array(texts), "n": np.concatenate(counts)}).group_by("phrase").aggregate([("n", "sum")])
        summed = summed.filter(pc.greater_equal(summed["n_sum"], least))
        size = pc.add(pc.count_substring(summed["phrase"], b" "), 1).cast(pa.int32())
        lang = pa.array([table["lang"][0].as_py()] * len(summed), pa.string())
        give_back_memory()
        return pa.table({"lang": lang, "phrase": summed["phrase"].cast(pa.string()), "size": size, "a": summed["n_sum"]})

    return run


def phrase_counts(docs: DataFrame, least: int, longest: int, text_col: str, lang_col: str, shard_words: int, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, a`` of all phrases that occur ``least`` times or more,
    and ``lang, total``: the words of each language. Both are tables."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    texts = docs.select(lang, F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    path = new_path(docs.sparkSession)
    texts.mapInArrow(_sharded(shard_words), _SHARD).write.options(**ROW_GROUPS).parquet(path)
    shards = docs.sparkSession.read.schema(_SHARD).parquet(path)
    totals = as_table(shards.groupBy("lang").agg(F.sum("n").alias("total")))
    n_words = int(totals.agg(F.sum("total").alias("n")).first()["n"] or 0)
    # A sixteenth of the hashes' values are taken at most, so few rare pairs share one.
    space, n_pieces = int(np.clip(np.ceil(np.log2(16 * n_words + 1)), LEAST_SPACE, MOST_SPACE)), pieces(n_words, PIECE_WORDS)
    words = _frequent(shards.select("hashes", "counts").mapInArrow(_word_counts(space, n_pieces), _PACKED), least, space, most_bits)
    pairs = _frequent(shards.mapInArrow(_pair_counts(words, space, n_pieces), _PACKED), least, space, most_bits)
    counts = shards.mapInArrow(_phrase_counts(words, pairs, longest, n_pieces), _PHRASES)
    counts = counts.groupBy("lang", "piece").applyInArrow(_frequent_phrases(least), "lang string, phrase string, size int, a long")
    return as_table(counts), totals


def _wide(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def _part(phrase: str, begin: Column, size: Column) -> Column:
    """So many words of a phrase from the word at ``begin``, counted from 0."""
    return F.array_join(F.slice(F.split(phrase, " "), begin + 1, size), " ")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, within: int = WITHIN,
    text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS, most_bits: int = MOST_BITS,
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates have 2 to ``longest`` words and occur ``a >= least`` times. Of the
    cuts of a phrase, with ``l`` and ``r`` occurrences of its parts, the one of
    least ``score``, ``2000000 * a div (l + r)``, counts, the first of equal ones.
    A candidate inside a longer one with ``within`` hundredths of its occurrences
    is dropped. ``n`` counts the language's words. Order is by score and ``a``,
    both descending, and the phrase's bytes.

    Null and empty texts have no words; a null language is ``und``. Repeated rows
    count each. Words are of any length. An empty table, or one without frequent
    phrases, gives no rows; other columns are ignored.
    """
    counts, totals = phrase_counts(docs, least, longest, text_col, lang_col, shard_words, most_bits)
    phrases = counts.where("size > 1")
    # Only single words are parts of very many phrases.
    salts = F.explode(F.sequence(F.lit(0), F.when(F.col("size") == 1, SALTS - 1).otherwise(0)))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(n), salts.alias("salt"))
    k = F.col("k")
    cuts = phrases.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    salt = lambda words: F.when(words == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(0)
    cuts = cuts.withColumns({"first": _part("phrase", F.lit(0), k), "rest": _part("phrase", k, F.col("size") - k)})
    cuts = cuts.withColumn("salt", salt(k)).join(part("first", "l"), ["lang", "first", "salt"])
    cuts = cuts.withColumn("salt", salt(F.col("size") - k)).join(part("rest", "r"), ["lang", "rest", "salt"])
    score = F.expr(f"(cast({SCALE} AS decimal(8,0)) * cast(a AS decimal(19,0))) div cast(l + r AS decimal(20,0))")
    lowest = F.min(F.struct(score.alias("score"), k.alias("k"), F.col("l"), F.col("r"))).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    spans = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(0, size - m), i -> struct(i, m))))")
    inside = phrases.where("size > 2").select("lang", "phrase", F.col("a").alias("of"), F.explode(spans).alias("x"))
    inside = inside.select("lang", _part("phrase", F.col("x.i"), F.col("x.m")).alias("phrase"), "of").groupBy("lang", "phrase").agg(F.max("of").alias("of"))
    kept = scored.join(inside, ["lang", "phrase"], "left")
    kept = kept.where(F.col("of").isNull() | (100 * _wide(F.col("of")) < within * _wide(F.col("a"))))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = ranked.join(F.broadcast(totals), "lang")  # a row for each language
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP11_SQL = rf"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^\x20\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)),
g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, {LONGEST + 1}) r(m))),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= {LEAST}),
k AS (SELECT lang, phrase, m, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : m], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang AS lang, k.phrase AS phrase, k.a AS a, x.a AS l, y.a AS r, (({SCALE}::HUGEINT * k.a) // (x.a + y.a))::BIGINT AS score,
  row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY ({SCALE}::HUGEINT * k.a) // (x.a + y.a), k) AS nth
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.head JOIN f y ON y.lang = k.lang AND y.phrase = k.tail),
i AS (SELECT lang, array_to_string(w[b : b + q - 1], ' ') AS phrase, max(a) AS longer FROM (
  SELECT lang, w, a, q, unnest(range(1, m - q + 2)) AS b FROM (SELECT *, unnest(range(2, m)) AS q FROM c)) GROUP BY 1, 2),
z AS (SELECT s.lang AS lang, s.phrase AS phrase, s.a AS a, l, r, score FROM s LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE nth = 1 AND (longer IS NULL OR 100 * longer < {WITHIN} * s.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT o.lang AS lang, rank, phrase, a, l, r, n, score FROM o JOIN t ON t.lang = o.lang WHERE rank <= {TOP}
"""
