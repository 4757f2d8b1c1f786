"""Exact substring deduplication by a depth-limited radix sort of suffixes.

Two suffixes are only compared through the first ``length`` bytes, the
threshold. Most-significant-digit passes of eight bytes refine groups of equal
prefixes and leave out groups of one suffix; what is still together at the full
depth are exactly the repeated windows. No full suffix array is built.

The sort is distributed by anchors. The anchor of a window is its k-gram with
the least hash, so equal windows have equal anchors at the same offset, and
about one byte in fourteen is an anchor. A window can only be repeated if its
anchor is. The work runs in three rounds over batches of documents:

1. Each batch sends the fingerprints of its anchors, five bytes each, and learns
   which of them occur elsewhere. A wrong match costs work but changes nothing.
2. Each batch sends the contexts of its repeated anchors, which hold all windows
   of an anchor, once for equal contexts. The windows of an anchor are sorted,
   and each learns the smallest document id that has it.
3. Each batch deletes the bytes of windows that a smaller document id has.

At the edges of a very common passage every document has another context of the
same anchor. An anchor that occurs in ``HOT`` batches, or ``HOT`` times in one, is
therefore not sent by its contexts: each of its windows goes, by a hash of 128
bits and once for equal windows of a batch, to a reducer of its own hash. No
anchor has more than ``HOT`` times ``HOT`` contexts in a reducer then.

Copies of whole documents are found by their hash beforehand; only the first of
them takes part, and texts that are too short for a window stay out of all this.
What batches send and learn is packed into byte strings, one for each batch and
reducer that shares an anchor, so there are never more of them than anchors.
"""

from __future__ import annotations

import ctypes
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_table, documents, pieces, text_bytes

#: Fixed odd multipliers of the rolling hash.
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
FP_BYTES = 5
#: Stands for a null document id: after all others.
FIRST, LAST = np.int64(-(2**63)), np.int64(2**63 - 1)
#: An anchor in so many batches, or so many times in a batch, is sent by windows.
HOT = 32
#: Batches whose share of the anchors goes to one reducer, and how many contexts
#: or windows it works on at a time.
BATCHES_OF_PART, AT_ONCE = 4, 1 << 15


def kgram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-gram of a byte array, by doubling."""
    count = len(data) - k + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    have, width = None, 0
    power, step = data.astype(np.uint64) * M1 + np.uint64(1), 1
    while True:
        if k & step:
            have = power if have is None else have[: len(have) - step] * M2 + power[width:]
            width += step
        if width == k:
            break
        power = power[:-step] * (M1 + np.uint64(2 * step)) + power[step:]
        power ^= power >> np.uint64(31)
        step *= 2
    have = have[:count]
    have = have ^ (have >> np.uint64(33))
    have *= M2
    return have ^ (have >> np.uint64(29))


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of each run of ``width`` values, by doubling."""
    size, out = 1, values
    while size * 2 <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    return best(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


@dataclass
class Anchors:
    """Anchors of a batch: hash, k-gram position, and the range of starts of the
    windows they are the anchor of. Positions count in the batch's bytes."""

    hash: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray


def anchors_of(data: np.ndarray, ends: np.ndarray, length: int, k: int, piece: int = 1 << 19) -> Anchors:
    """Anchors of all windows of the documents that end at ``ends``.

    Long batches are worked off in overlapping pieces of bounded size. A window
    that runs over the end of its document is none.
    """
    w = length - k + 1
    found = []
    for start in range(0, max(len(data) - length + 1, 0), piece):
        # windows that start in [start, stop); anchors need the windows to either side
        stop = min(start + piece, len(data) - length + 1)
        left = max(0, start - w)
        right = min(len(data), stop + length + w)
        h = np.maximum(kgram_hashes(data[left:right], k), np.uint64(1))  # zero stands for no window
        least = sliding(h, w, np.minimum)
        ok = _inside(ends, left, len(least), length)
        value = np.where(ok, least, np.uint64(0))
        # a k-gram is an anchor if a window that holds it has its hash as least
        padded = np.concatenate([np.zeros(w - 1, np.uint64), value, np.zeros(w - 1, np.uint64)])
        top = sliding(padded, w, np.maximum)[: len(h)]
        at = np.flatnonzero(top == h)
        grid = at[:, None] + np.arange(1 - w, 1)[None, :]
        good = (grid >= 0) & (grid < len(value))
        same = good & (value[np.clip(grid, 0, len(value) - 1)] == h[at][:, None])
        first = same.argmax(axis=1)
        last = w - 1 - same[:, ::-1].argmax(axis=1)
        low, high = at + 1 - w + first + left, at + 1 - w + last + left
        # each window belongs to the piece in which it starts
        low, high = np.maximum(low, start), np.minimum(high, stop - 1)
        keep = low <= high
        # least hashes are small numbers; times an odd one they are spread again
        found.append((h[at][keep] * M1, at[keep] + left, low[keep], high[keep]))
    if not found:
        none = np.zeros(0, np.int64)
        return Anchors(np.zeros(0, np.uint64), none, none, none)
    return Anchors(*(np.concatenate(c) for c in zip(*found, strict=True)))


def _inside(ends: np.ndarray, left: int, count: int, length: int) -> np.ndarray:
    """Whether each window from ``left`` on ends within its document."""
    out = np.ones(count, bool)
    a, b = np.searchsorted(ends, left, "right"), np.searchsorted(ends, left + count + length, "right")
    for end in ends[a : b + 1]:
        out[max(0, end - length + 1 - left) : max(0, min(count, end - left))] = False
    return out


def radix_groups(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Refine ``group`` to equal rows of ``words`` (rows x digits).

    Most-significant-digit passes; rows that are alone are left out of the
    later ones. Returns a label for each row: equal labels are equal rows.
    """
    label = np.unique(group, return_inverse=True)[1].astype(np.int64)
    rows = np.arange(len(label))
    for digit in range(words.shape[1] + 1):
        size = np.bincount(label[rows], minlength=0) if len(rows) else np.zeros(0, int)
        rows = rows[size[label[rows]] > 1] if len(rows) else rows
        if digit == words.shape[1] or not len(rows):
            break
        order = np.lexsort((words[rows, digit], label[rows]))
        rows = rows[order]
        g, d = label[rows], words[rows, digit]
        fresh = np.r_[False, (g[1:] == g[:-1]) & (d[1:] != d[:-1])]
        new = np.r_[True, g[1:] != g[:-1]] | fresh
        # the first part of a group keeps its label, the others get new ones
        run = np.cumsum(new) - 1
        name = g[new].copy()
        added = fresh[new]
        name[added] = label.max() + 1 + np.arange(added.sum())
        label[rows] = name[run]
    return label


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class Batch:
    """The documents of one batch as one byte array."""

    def __init__(self, table: pa.Table, copies: np.ndarray, length: int):
        ids = table["doc_id"].fill_null(int(LAST)).to_numpy()
        texts = table["text"].to_pylist()
        self.order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))  # the same in each round
        known = set(map(tuple, copies.reshape(-1, 2).tolist()))  # id and hash: ids may repeat
        self.copy = [len(texts[i]) >= length and (int(ids[i]), _signed(xxhash.xxh64_intdigest(texts[i], 42))) in known for i in self.order]
        self.ids = ids[self.order]
        self.null = [table["doc_id"][i].as_py() is None for i in self.order]
        self.texts = [texts[i] for i in self.order]
        used = [b"" if c else t for t, c in zip(self.texts, self.copy, strict=True)]
        self.data = np.frombuffer(b"".join(used), np.uint8)
        self.ends = np.cumsum([len(t) for t in used]).astype(np.int64)
        self.begins = self.ends - np.array([len(t) for t in used], np.int64)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")


def give_back_memory() -> None:
    """Return what a batch has freed to the system: workers stay for the next stage,
    and what they hold counts beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The reducer of an anchor: ranges of the hash's upper bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _pack_fingerprints(hashes: np.ndarray, many: np.ndarray) -> bytes:
    """Five bytes for each hash, and a bit for those that occur often here."""
    return hashes.view(np.uint8).reshape(-1, 8)[:, :FP_BYTES].tobytes() + np.packbits(many).tobytes()


def match_fingerprints(blobs: list[bytes]) -> list[bytes]:
    """For the fingerprints that the batches sent to a reducer: a bit for each
    that another batch has too, and one for each that is hot."""
    counts = [8 * len(b) // (8 * FP_BYTES + 1) for b in blobs]
    wide = np.zeros((sum(counts), 8), np.uint8)
    wide[:, :FP_BYTES] = np.frombuffer(b"".join(b[: FP_BYTES * n] for b, n in zip(blobs, counts, strict=True)), np.uint8).reshape(-1, FP_BYTES)
    many = [np.unpackbits(np.frombuffer(b, np.uint8, -1, FP_BYTES * n), count=n) for b, n in zip(blobs, counts, strict=True)]
    _, where, size = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    hot = (size >= HOT) | (np.bincount(where, np.concatenate(many), len(size)) > 0)
    cuts = np.cumsum(counts)[:-1]
    parts = zip(np.split((size > 1)[where], cuts), np.split(hot[where], cuts), strict=True)
    return [np.packbits(twice).tobytes() + np.packbits(often).tobytes() for twice, often in parts]


def _repeated(batch: Batch, anchors: Anchors, notes: dict[int, bytes], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchor hashes in ascending order, which of them are repeated,
    and which are hot."""
    distinct, where = np.unique(anchors.hash, return_inverse=True)
    doc = batch.doc_of(anchors.at)
    low, high = np.full(len(distinct), len(batch.ids)), np.full(len(distinct), -1)
    np.minimum.at(low, where, doc)
    np.maximum.at(high, where, doc)
    known, hot = low != high, np.zeros(len(distinct), bool)
    bounds = np.searchsorted(_part_of(distinct, parts), np.arange(parts + 1))
    for p, bits in notes.items():
        a, b = bounds[p], bounds[p + 1]
        flags = np.frombuffer(bits, np.uint8).reshape(2, -1)
        known[a:b] |= np.unpackbits(flags[0], count=b - a).astype(bool)
        hot[a:b] = np.unpackbits(flags[1], count=b - a)
    return distinct, known, hot & known


@dataclass
class Windows:
    """The distinct windows of hot anchors, ascending by their two hashes.

    ``start`` and ``window`` pair each occurrence (a position) with its window."""

    hash: np.ndarray
    other: np.ndarray
    least: np.ndarray  # smallest and largest document id in this batch
    most: np.ndarray
    start: np.ndarray
    window: np.ndarray


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from each ``low`` to its ``high``."""
    size = high - low + 1
    return np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(low) else np.zeros(0, np.int64)


def windows_of(batch: Batch, anchors: Anchors, distinct: np.ndarray, hot: np.ndarray, length: int, step: int = 1 << 17) -> Windows:
    """The windows of the hot anchors; equal ones are merged."""
    of = np.flatnonzero(hot[np.searchsorted(distinct, anchors.hash)])
    start = np.unique(_ranges(anchors.low[of], anchors.high[of]))
    one, two = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    for i in range(0, len(start), step):
        some = start[i : i + step]
        words = _window_words(batch.data, some, np.full(len(some), length), _digits(length))
        for h, m, turn in ((one, M1, 31), (two, M2, 29)):
            x = np.full(len(some), m ^ np.uint64(length))
            for word in words.T:
                x = (x ^ word) * m
                x ^= x >> np.uint64(turn)
                x = (x << np.uint64(turn) | x >> np.uint64(64 - turn)) * (m ^ np.uint64(0x2545F4914F6CDD1C))
            h[i : i + step] = x ^ (x >> np.uint64(32))
    order = np.lexsort((two, one))
    new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])] if len(order) else np.zeros(0, bool)
    window = np.empty(len(order), np.int64)
    window[order] = np.cumsum(new) - 1
    ids = batch.ids[batch.doc_of(start)]
    least, most = np.full(new.sum(), LAST), np.full(new.sum(), FIRST)
    np.minimum.at(least, window, ids)
    np.maximum.at(most, window, ids)
    return Windows(one[order][new], two[order][new], least, most, start, window)


def _pack_ids(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Ids as differences to the least: base and width, and the numbers."""
    base = int(ids.min()) if len(ids) else 0
    near = _above(ids, base)
    return np.array([base, near.itemsize], np.int64).tobytes(), near.tobytes()


def _above(ids: np.ndarray, base: int) -> np.ndarray:
    """How far ids are above ``base``, unsigned as any two ids can be 2**64 - 1 apart;
    in 32 bits if all fit. Added to ``base`` in 64 bits they are the ids again."""
    near = ids.astype(np.int64).view(np.uint64) - np.uint64(base % 2**64)
    return near if len(near) and near.max() >= 2**32 else near.astype(np.uint32)


def _unpack_ids(blob: bytes, at: int, n: int, base: int, width: int) -> np.ndarray:
    return np.frombuffer(blob, np.int64 if width == 8 else np.uint32, n, at).astype(np.int64) + base


def _pack_windows(found: Windows, a: int, b: int) -> bytes:
    head, ids = _pack_ids(found.least[a:b])
    return np.int64(b - a).tobytes() + head + found.hash[a:b].tobytes() + found.other[a:b].tobytes() + (found.most[a:b] > found.least[a:b]).tobytes() + ids


def _hash_ranges(hashes: list[np.ndarray], most: int) -> list[list[slice]]:
    """Ranges of hashes with about ``most`` entries: the slices of each ascending
    array, equal hashes together."""
    every = np.sort(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    bounds = np.unique(every[most::most])
    cuts = [np.r_[0, np.searchsorted(h, bounds), len(h)] for h in hashes]
    return [[slice(c[i], c[i + 1]) for c in cuts] for i in range(len(bounds) + 1)]


def smallest_of_windows(blobs: list[bytes]) -> list[bytes]:
    """For the windows that the batches sent to a reducer: those that have a
    smaller id elsewhere or several ids in the batch, with the smallest id."""
    parts = []
    for blob in blobs:
        n, base, width = (int(x) for x in np.frombuffer(blob, np.int64, 3))
        one, two = np.frombuffer(blob, np.uint64, 2 * n, 24).reshape(2, n)
        parts.append((one, two, np.frombuffer(blob, bool, n, 24 + 16 * n), _unpack_ids(blob, 24 + 17 * n, n, base, width)))
    told: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in parts]
    lowest: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in parts]
    for here in _hash_ranges([p[0] for p in parts], 8 * AT_ONCE):
        one, two, several, own = (np.concatenate([p[i][cut] for p, cut in zip(parts, here, strict=True)]) for i in range(4))
        order = np.lexsort((two, one))
        new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])] if len(order) else np.zeros(0, bool)
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        least = np.full(new.sum(), LAST)
        np.minimum.at(least, kind, own)
        start = 0
        for p, cut in enumerate(here):
            rows = slice(start, start + cut.stop - cut.start)
            found = np.flatnonzero((least[kind[rows]] < own[rows]) | several[rows])
            told[p].append(found + cut.start)
            lowest[p].append(least[kind[rows]][found])
            start = rows.stop
    replies = []
    for at, ids in zip(map(np.concatenate, told), map(np.concatenate, lowest), strict=True):
        head, packed = _pack_ids(ids)
        replies.append(np.int64(len(at)).tobytes() + head + at.astype(np.uint32).tobytes() + packed)
    return replies


def _apply_windows(batch: Batch, found: Windows, replies: dict[int, bytes], parts: int, length: int) -> np.ndarray:
    """Marks of the bytes to delete for windows of hot anchors, as differences."""
    least = np.full(len(found.hash), LAST)
    bounds = np.searchsorted(_part_of(found.hash, parts), np.arange(parts + 1))
    for p, blob in replies.items():
        n, base, width = (int(x) for x in np.frombuffer(blob, np.int64, 3))
        told = np.frombuffer(blob, np.uint32, n, 24).astype(np.int64) + bounds[p]
        least[told] = _unpack_ids(blob, 24 + 4 * n, n, base, width)
    hit = found.start[least[found.window] < batch.ids[batch.doc_of(found.start)]]
    gone = np.zeros(len(batch.data) + 1, np.int32)
    gone[hit] += 1  # positions are distinct
    gone[hit + length] -= 1
    return gone


@dataclass
class Contexts:
    """Distinct contexts of repeated anchors, ascending by hash.

    ``member`` and ``context`` pair each occurrence (a row of the anchors) with
    its context."""

    hash: np.ndarray
    first: np.ndarray  # an occurrence: row of the anchors
    least: np.ndarray  # smallest and largest document id in this batch
    most: np.ndarray
    member: np.ndarray
    context: np.ndarray


def _window_words(data: np.ndarray, low: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Bytes from ``low`` on, zero after ``size``, as big-endian digits."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[low]
    if (size < width).any():
        rows = np.where(np.arange(width)[None, :] < size[:, None], rows, np.uint8(0))
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def _digits(length: int) -> int:
    return -(-length // 8) * 8


def contexts_of(batch: Batch, anchors: Anchors, distinct: np.ndarray, known: np.ndarray, length: int, k: int) -> Contexts:
    """Merge the occurrences whose contexts are equal."""
    slot = np.searchsorted(distinct, anchors.hash)
    member = np.flatnonzero(known[slot])
    member = member[np.argsort(anchors.hash[member], kind="stable")]
    size = anchors.high[member] - anchors.low[member] + length
    back = anchors.at[member] - anchors.low[member]
    group = slot[member] * (4 * length) * (2 * length) + back * (2 * length) + size
    label = radix_groups(_window_words(batch.data, anchors.low[member], size, _digits(2 * length)), group)
    order = np.lexsort((np.arange(len(label)), label))
    begins = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]]) if len(label) else np.zeros(0, int)
    owner = np.zeros(len(label), np.int64)
    owner[order] = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(label)]))
    first = member[order[begins]] if len(begins) else np.zeros(0, np.int64)
    rank = np.lexsort((anchors.low[first], anchors.hash[first]))
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    first, owner = first[rank], place[owner]
    ids = batch.ids[batch.doc_of(anchors.at[member])]
    least, most = np.full(len(first), LAST), np.full(len(first), FIRST)
    np.minimum.at(least, owner, ids)
    np.maximum.at(most, owner, ids)
    return Contexts(anchors.hash[first], first, least, most, member, owner)


def _pack_contexts(batch: Batch, anchors: Anchors, found: Contexts, a: int, b: int, length: int) -> bytes:
    """Contexts ``a`` to ``b``: count, hashes, offsets, sizes, ids, bytes."""
    rows = found.first[a:b]
    low = anchors.low[rows]
    size = anchors.high[rows] - low + length
    back = (anchors.at[rows] - low).astype(np.uint16)
    index = np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    base = int(found.least[a:b].min())
    head = np.array([b - a, base], np.int64).tobytes()
    near = _above(found.least[a:b], base)
    return head + bytes([near.itemsize]) + found.hash[a:b].tobytes() + back.tobytes() + size.astype(np.uint16).tobytes() + near.tobytes() + (found.most[a:b] > found.least[a:b]).tobytes() + batch.data[index].tobytes()


def _unpack_contexts(blob: bytes) -> tuple[np.ndarray, ...]:
    n, base = np.frombuffer(blob, np.int64, 2)
    n, at, out = int(n), 17, []
    for kind in (np.uint64, np.uint16, np.uint16, np.dtype(np.int64 if blob[16] == 8 else np.uint32), np.dtype(bool)):
        width = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(blob, kind, n, at))
        at += width
    hashes, back, size, near, several = out
    return hashes, back.astype(np.int64), size.astype(np.int64), near.astype(np.int64) + base, several, np.frombuffer(blob, np.uint8, -1, at)


def _slices(group: np.ndarray, weight: np.ndarray, most: int = 1 << 18) -> list[slice]:
    """Cut ascending groups into slices of about ``most`` in weight, groups whole."""
    if not len(group):
        return []
    cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
    part = np.cumsum(weight)[cuts - 1] // most
    cuts = cuts[np.flatnonzero(np.diff(np.r_[0, part]) > 0)]
    return [slice(a, b) for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(group)], strict=True)]


def smallest_ids(blobs: list[bytes], length: int) -> list[bytes]:
    """For the contexts that the batches sent to a reducer: what each learns.

    A reply lists contexts by their number, each with the smallest document id
    for each window, as runs of equal ids. Contexts that have no smaller id
    than their own are left out.
    """
    parts = [_unpack_contexts(b) for b in blobs]
    begins = [np.r_[0, np.cumsum(p[2])] for p in parts]
    found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in parts]
    for here in _hash_ranges([p[0] for p in parts], AT_ONCE):
        some = [(*(c[cut] for c in p[:5]), p[5][at[cut.start] : at[cut.stop]]) for p, at, cut in zip(parts, begins, here, strict=True)]
        if not any(len(x[0]) for x in some):
            continue
        for p, (cut, (told, *rest)) in enumerate(zip(here, _least_of_contexts(some, length), strict=True)):
            found[p].append((told + cut.start, *rest))
    replies = []
    for own in found:
        told, runs, width, ids = (np.concatenate([x[i] for x in own]) if own else np.zeros(0, np.int64) for i in range(4))
        base = int(ids.min()) if len(ids) else 0
        near = _above(ids, base)
        head = np.array([len(told), len(ids), base, near.itemsize], np.int64).tobytes()
        short = np.uint8 if length < 250 else np.uint16
        replies.append(head + told.astype(np.uint32).tobytes() + runs.astype(short).tobytes() + width.astype(np.uint16).tobytes() + near.tobytes())
    return replies


def _least_of_contexts(parts: list[tuple[np.ndarray, ...]], length: int) -> list[tuple[np.ndarray, ...]]:
    """For each batch: the contexts that learn something, how many runs each has,
    and the width and id of the runs."""
    hashes, back, size, own, several = (np.concatenate([p[i] for p in parts]) for i in range(5))
    data = np.concatenate([p[5] for p in parts])
    begin = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
    _, anchor = np.unique(hashes, return_inverse=True)
    # equal contexts first; most anchors have one only
    label = radix_groups(_window_words(data, begin, size, _digits(2 * length)), anchor * (4 * length) * (2 * length) + back * (2 * length) + size)
    kinds, first, label = np.unique(label, return_index=True, return_inverse=True)
    least = np.full(len(kinds), LAST)
    np.minimum.at(least, label, own)
    per_anchor = np.bincount(anchor[first], minlength=anchor.max() + 1)
    mixed = np.flatnonzero(per_anchor[anchor[first]] > 1)
    # windows of the distinct contexts of anchors that have several
    count = size[first] - length + 1
    windows = np.where(per_anchor[anchor[first]] > 1, count, 1)
    slot = np.r_[0, np.cumsum(windows)]
    value = np.repeat(least, windows)
    mixed = mixed[np.argsort(anchor[first[mixed]], kind="stable")]
    for some in _slices(anchor[first[mixed]], count[mixed]):
        own_count = count[mixed[some]]
        rows = np.repeat(mixed[some], own_count)
        step = np.arange(len(rows)) - np.repeat(np.cumsum(own_count) - own_count, own_count)
        at = begin[first[rows]] + step
        group = anchor[first[rows]] * (4 * length) + back[first[rows]] - step + 2 * length
        same = radix_groups(_window_words(data, at, np.full(len(at), length), _digits(length)), group)
        low = np.full(same.max() + 1, LAST)
        np.minimum.at(low, same, least[rows])
        value[slot[rows] + step] = low[same]
    lowest = np.minimum.reduceat(value, slot[:-1]) if len(kinds) else value
    replies, start = [], 0
    for p in parts:
        n = len(p[0])
        kind = label[start : start + n]
        told = np.flatnonzero((lowest[kind] < own[start : start + n]) | several[start : start + n])
        k = kind[told]
        take = windows[k]
        index = np.repeat(slot[k] - np.r_[0, np.cumsum(take)[:-1]], take) + np.arange(take.sum()) if len(k) else np.zeros(0, np.int64)
        ids, of = value[index], np.repeat(np.arange(len(k)), take)
        full = np.repeat(np.where(per_anchor[anchor[first[k]]] > 1, 1, count[k]), take)  # windows for each value
        new = np.r_[True, (ids[1:] != ids[:-1]) | (of[1:] != of[:-1])] if len(ids) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        width = np.add.reduceat(full, heads) if len(heads) else np.zeros(0, np.int64)
        replies.append((told, np.bincount(of[heads], minlength=len(k)), width, ids[heads]))
        start += n
    return replies


def _apply(batch: Batch, anchors: Anchors, found: Contexts, replies: dict[int, bytes], parts: int, length: int) -> np.ndarray:
    """Marks of the bytes to delete, as differences."""
    gone = np.zeros(len(batch.data) + 1, np.int32)
    bounds = np.searchsorted(_part_of(found.hash, parts), np.arange(parts + 1))
    by_context = np.argsort(found.context, kind="stable")
    from_, to = (np.searchsorted(found.context[by_context], np.arange(len(found.hash)), s) for s in ("left", "right"))
    for p, blob in replies.items():
        n, m, base, wide = np.frombuffer(blob, np.int64, 4)
        at = 32
        told = np.frombuffer(blob, np.uint32, n, at).astype(np.int64) + bounds[p]
        at += 4 * n
        kind = np.uint8 if length < 250 else np.uint16
        runs = np.frombuffer(blob, kind, n, at).astype(np.int64)
        at += n * np.dtype(kind).itemsize
        width = np.frombuffer(blob, np.uint16, m, at).astype(np.int64)
        at += 2 * m
        least = np.frombuffer(blob, np.int64 if wide == 8 else np.uint32, m, at).astype(np.int64) + base
        of = np.repeat(np.arange(n), runs)
        before = np.cumsum(width) - width
        shift = before - before[np.r_[0, np.cumsum(runs)[:-1]]][of] if n else before
        # each occurrence of a context takes each of its runs
        times = (to - from_)[told][of]
        run = np.repeat(np.arange(m), times)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
        who = found.member[by_context[from_[told[of[run]]] + nth]]
        doc = batch.doc_of(anchors.at[who])
        hit = least[run] < batch.ids[doc]
        begin = anchors.low[who[hit]] + shift[run[hit]]
        np.add.at(gone, begin, 1)
        np.add.at(gone, begin + width[run[hit]] - 1 + length, -1)
    return gone


def remove_repeats(docs: DataFrame, length: int = 50, batch_bytes: int = 3 << 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Delete every byte of a repeated window of ``length`` bytes but in the first document.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with
    ``with_text``, ``kept`` (bytes, since a deletion may cut a character). A
    byte goes if a window over it also starts in a document of a smaller id;
    windows are judged on the input and don't cross documents.

    Null and empty texts have no bytes. Texts shorter than ``length`` stay.
    Null ids come after all others. Rows that share an id are not smaller than
    each other, so they don't delete from each other. An empty table gives no
    rows; other columns are ignored.
    """
    k = length // 2
    total = text_bytes(docs, text_col)
    batches = pieces(total, batch_bytes)
    parts = pieces(batches, BATCHES_OF_PART)
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    raw = raw.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int"))  # also by text, since an id may repeat
    hashed = as_table(raw.where(F.length("text") >= length).select("batch", "doc_id", F.xxhash64("text").alias("h"), F.unhex(F.sha2("text", 256)).alias("sha")))
    firsts = as_table(hashed.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))  # a table, so that the join can split a very common text
    later = F.col("doc_id").isNull() & F.col("first").isNotNull() | (F.col("doc_id") > F.col("first"))
    copies = hashed.join(firsts, "sha").where(later).select("batch", F.lit(-1).alias("part"), F.array(F.coalesce("doc_id", F.lit(int(LAST))), F.col("h")).alias("copy"))
    copies = as_table(copies.groupBy("batch", "part").agg(F.flatten(F.collect_list("copy")).alias("ids")).select("batch", "part", F.lit(b"").alias("blob"), "ids"))
    rows = raw.where(F.length("text") >= length).select("batch", "doc_id", "text")
    empty = pa.schema([("batch", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])

    def read(key, table: pa.Table, notes: pa.Table):
        part, blob = notes["part"].to_pylist(), notes["blob"].to_pylist()
        ids = [np.array(x, np.int64) for p, x in zip(part, notes["ids"].to_pylist(), strict=True) if p == -1]
        batch = Batch(table, np.concatenate(ids) if ids else np.zeros(0, np.int64), length)
        return batch, anchors_of(batch.data, batch.ends, length, k), part, blob

    def out(number: int, parts_: list[int], blobs: list[bytes]) -> pa.Table:
        give_back_memory()
        return pa.table([pa.array([number] * len(blobs), pa.int32()), pa.array(parts_, pa.int32()), pa.array(blobs, pa.binary())], schema=empty)

    def send_fingerprints(key, table: pa.Table, notes: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty.empty_table()
        batch, anchors, _, _ = read(key, table, notes)
        distinct, times = np.unique(anchors.hash, return_counts=True)
        bounds = np.searchsorted(_part_of(distinct, parts), np.arange(parts + 1))
        used = np.flatnonzero(np.diff(bounds)).tolist()
        blobs = [_pack_fingerprints(distinct[bounds[p] : bounds[p + 1]], times[bounds[p] : bounds[p + 1]] >= HOT) for p in used]
        del batch, anchors
        return out(key[0].as_py(), used, blobs)

    def match(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        bits = match_fingerprints(table["blob"].to_pylist())
        return pa.table({"batch": table["batch"], "part": table["part"], "blob": pa.array(bits, pa.binary())})

    def send_contexts(key, table: pa.Table, notes: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty.empty_table()
        batch, anchors, part, blob = read(key, table, notes)
        distinct, known, hot = _repeated(batch, anchors, {p: b for p, b in zip(part, blob, strict=True) if p >= 0}, parts)
        found = contexts_of(batch, anchors, distinct, known & ~hot, length, k)
        bounds = np.searchsorted(_part_of(found.hash, parts), np.arange(parts + 1))
        used = np.flatnonzero(np.diff(bounds)).tolist()
        sent = [_pack_contexts(batch, anchors, found, bounds[p], bounds[p + 1], length) for p in used]
        windows = windows_of(batch, anchors, distinct, hot, length)
        bounds = np.searchsorted(_part_of(windows.hash, parts), np.arange(parts + 1))
        often = np.flatnonzero(np.diff(bounds)).tolist()
        sent += [_pack_windows(windows, bounds[p], bounds[p + 1]) for p in often]
        del batch, anchors, found, windows
        return out(key[0].as_py(), used + [p + 2 * parts for p in often], sent)

    def sort(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        blobs = table["blob"].to_pylist()
        hot = table["part"][0].as_py() >= 2 * parts
        replies = smallest_of_windows(blobs) if hot else smallest_ids(blobs, length)
        give_back_memory()
        shifted = pa.array([p + parts for p in table["part"].to_pylist()], pa.int32())
        return pa.table({"batch": table["batch"], "part": shifted, "blob": pa.array(replies, pa.binary())})

    def delete(key, table: pa.Table, notes: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        batch, anchors, part, blob = read(key, table, notes)
        told = [{p - i * parts: b for p, b in zip(part, blob, strict=True) if i * parts <= p < (i + 1) * parts} for i in range(4)]
        distinct, known, hot = _repeated(batch, anchors, told[0], parts)
        found = contexts_of(batch, anchors, distinct, known & ~hot, length, k)
        gone = _apply(batch, anchors, found, told[1], parts, length)
        gone += _apply_windows(batch, windows_of(batch, anchors, distinct, hot, length), told[3], parts, length)
        gone = np.cumsum(gone[:-1]) > 0
        result = []
        for i, text in enumerate(batch.texts):
            if batch.copy[i]:
                removed, spans, kept = len(text), 1, b""
            else:
                mask = gone[batch.begins[i] : batch.ends[i]]
                removed = int(mask.sum())
                spans = int((mask & ~np.r_[False, mask[:-1]]).sum()) if removed else 0
                kept = batch.data[batch.begins[i] : batch.ends[i]][~mask].tobytes() if removed else text
            row = (None if batch.null[i] else int(batch.ids[i]), len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept)
            result.append(row[: len(names)])
        del batch, anchors, found, gone
        give_back_memory()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*result, strict=True), types, strict=True)], names=names)

    of_batch = rows.groupBy("batch")
    plain = "batch int, part int, blob binary"
    with_ids = lambda df: df.withColumn("ids", F.lit(None).cast("array<long>"))
    asked = of_batch.cogroup(copies.groupBy("batch")).applyInArrow(send_fingerprints, plain)
    matched = with_ids(asked.groupBy("part").applyInArrow(match, plain))
    known = copies.unionByName(matched)
    sent = of_batch.cogroup(known.groupBy("batch")).applyInArrow(send_contexts, plain)
    sorted_ = with_ids(sent.groupBy("part").applyInArrow(sort, plain))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    cut = of_batch.cogroup(known.unionByName(sorted_).groupBy("batch")).applyInArrow(delete, schema)
    short = raw.where(F.length("text") < length).select(
        "doc_id", F.length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), *([F.col("text").alias("kept")] if with_text else []),
    )
    return cut.unionByName(short)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False)


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS win FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM w),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM f WHERE first < doc_id),
g AS (SELECT doc_id, i, sum((prev IS NULL OR i > prev + 50)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM s),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, span),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS aa, list(b ORDER BY a) AS bb FROM sp GROUP BY doc_id),
t AS (SELECT d.doc_id, h, length(h) // 2 AS n, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed,
  [0] || coalesce(bb, []) AS froms, coalesce(aa, []) || [length(h) // 2] AS tos FROM d LEFT JOIN k ON k.doc_id = d.doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(tos) + 1), lambda i: substr(h, 2 * froms[i] + 1, 2 * (tos[i] - froms[i]))), ''))) AS kept_sha256
FROM t
"""
