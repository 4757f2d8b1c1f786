"""Media columns as progressive JPEG.

``decode`` reads any progressive (or baseline) Huffman JPEG: the scans'
spectral-selection and successive-approximation steps are accumulated in
coefficient arrays, which are dequantised and inverse-transformed in numpy;
chroma is upsampled, and the result is a full-resolution RGB tensor.

``encode`` stores bytes losslessly in the format's unit, the coefficient. 192
bytes fill one block of each of the three components. A byte becomes a
coefficient of 128 to 255 in size, whose upper seven bits (with the sign) go into
a first scan and whose lowest bit goes into a refinement scan. All codes of such
a stream have a fixed rate of eight bits, so that whole scans can be written and
read by array operations; ``decode`` finds from the Huffman tables whether that
holds for a scan, and decodes bit by bit if not.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_table, documents

UNIT = 192
#: Most blocks in a column of blocks (a height is a 16-bit number).
MOST_ROWS = 8191


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag position: anti-diagonals, turning about."""
    cells = sorted(((u + v, u if (u + v) % 2 else v, u, v) for u in range(8) for v in range(8)))
    return np.array([u * 8 + v for _, _, u, v in cells])


ZIGZAG = _zigzag()
#: basis[u, x] of the 8-point inverse transform
BASIS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])

_HEAD = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


# --- writing ---------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, number: int, symbol: int) -> bytes:
    """A Huffman table whose only symbol has the code 0."""
    return _segment(0xC4, bytes([kind << 4 | number, 1]) + bytes(15) + bytes([symbol]))


def _scan(parts: list[tuple[int, int]], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    body = bytes([len(parts)]) + b"".join(bytes([c, t]) for c, t in parts) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, body) + data


_TABLES = _table(0, 0, 7) + _table(1, 0, 7) + _table(1, 1, 0)
_QUANT = _segment(0xDB, bytes([0]) + bytes([1]) * 64)


def pad(data: bytes) -> bytes:
    """Filled with spaces to a positive multiple of 192 bytes."""
    return data + b" " * ((-len(data)) % UNIT if data else UNIT)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds ``payload``, a positive multiple of 192 bytes."""
    units = len(payload) // UNIT
    cols = -(-units // MOST_ROWS)
    rows = -(-units // cols)
    blocks = np.frombuffer(payload + b" " * (UNIT * (rows * cols - units)), np.uint8).reshape(-1, 3, 64)
    upper, lowest = blocks >> 1, blocks & 1
    count = len(blocks)
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _QUANT]
    frame = bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * cols).to_bytes(2, "big") + bytes([3])
    out += [_segment(0xC2, frame + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))), _TABLES]
    # DC: the predictor starts anew at each unit
    marks = np.empty((count, 5), np.uint8)
    marks[:, :3] = upper[:, :, 0]
    marks[:, 3] = 0xFF
    marks[:, 4] = 0xD0 + np.arange(count) % 8
    all_three = [(1, 0), (2, 0), (3, 0)]
    out += [_segment(0xDD, b"\x00\x01"), _scan(all_three, 0, 0, 0, 1, marks.tobytes()[:-2]), _segment(0xDD, b"\x00\x00")]
    bits = np.packbits(np.r_[lowest[:, :, 0].ravel(), np.ones(-3 * count % 8, np.uint8)]).tobytes()
    out.append(_scan(all_three, 0, 0, 1, 0, bits.replace(b"\xff", b"\xff\x00")))
    for c in range(3):
        for first, last in ((1, 5), (6, 63)):
            out.append(_scan([(c + 1, 0)], first, last, 0, 1, upper[:, c, first : last + 1].tobytes()))
    for c in range(3):
        bits = lowest[:, c, :].copy()
        bits[:, 0] = 0  # the code for the end of the band; 63 correction bits follow
        out.append(_scan([(c + 1, 1)], 1, 63, 1, 0, np.packbits(bits, axis=1).tobytes().replace(b"\xff", b"\xff\x00")))
    return b"".join(out) + b"\xff\xd9"


# --- reading ---------------------------------------------------------------


@dataclass
class Component:
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks that interleaved scans cover
    high: int = 0
    own_wide: int = 0  # blocks that hold samples
    own_high: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # blocks x 64, zigzag


@dataclass
class Image:
    width: int
    height: int
    parts: dict[int, Component]
    quants: dict[int, np.ndarray]
    comments: list[bytes]


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) of each symbol."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


#: Tables that were read before; images of one source share them.
_SEEN_TABLES: dict[bytes, dict[tuple[int, int], int]] = {}


class _Bits:
    """Bits of a segment without stuffing; ones after its end."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | (self.bits[self.at] if self.at < len(self.bits) else 1)
            self.at += 1
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _slow_block(bits: _Bits, block: np.ndarray, dc, ac, first: int, last: int, high: int, low: int, state: dict) -> None:
    """One block of one scan, progressive or (0, 63, 0, 0) sequential."""
    k = first
    if k == 0:
        if high:
            block[0] |= bits.take(1) << low
        else:
            state["pred"] += bits.signed(bits.symbol(dc))
            block[0] = state["pred"] << low
        k = 1
        if last == 0:
            return
    if not high:
        if state["eob"]:
            state["eob"] -= 1
            return
        while k <= last:
            run, size = divmod(bits.symbol(ac), 16)
            if size:
                k += run
                block[k] = bits.signed(size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                state["eob"] = (1 << run) + bits.take(run) - 1
                return
        return
    one = 1 << low

    def refine(i: int) -> None:
        if bits.take(1):
            block[i] += one if block[i] > 0 else -one

    if not state["eob"]:
        while k <= last:
            run, size = divmod(bits.symbol(ac), 16)
            new = 0
            if size:
                new = one if bits.take(1) else -one
            elif run < 15:
                state["eob"] = (1 << run) + bits.take(run)
                break
            while k <= last:
                if block[k]:
                    refine(k)
                elif run == 0:
                    block[k] = new
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
    if state["eob"]:
        for i in range(k, last + 1):
            if block[i]:
                refine(i)
        state["eob"] -= 1


#: The value of seven extra bits of a size of seven.
SEVEN = np.array([v if v >= 64 else v - 127 for v in range(128)], np.int32)


def _fast_scan(image: Image, parts: list[Component], dc, ac, first: int, last: int, high: int, low: int, restart: int, data: bytes) -> bool:
    """Read a scan of fixed rate; False if it isn't one.

    Fixed rates: DC of size 7 alone between restarts; DC refinement; AC of run
    0 and size 7 throughout; AC refinement of blocks without a zero.
    """
    if any(p.wide != p.own_wide or p.high != p.own_high or p.h * p.v != 1 for p in parts) and len(parts) > 1:
        return False
    count = parts[0].own_wide * parts[0].own_high
    if any(len(p.coef) != count for p in parts):
        return False
    n = len(parts)
    if first == 0 and last == 0:
        if high:
            plain = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
            if restart or len(plain) != -(-n * count // 8):
                return False
            bits = np.unpackbits(plain, count=n * count).reshape(count, n)
            for i, p in enumerate(parts):
                p.coef[:, 0] |= bits[:, i].astype(np.int32) << low
            return True
        if restart != 1 or any(t != {(1, 0): 7} for t in dc) or len(data) != count * (n + 2) - 2:
            return False
        rows = np.frombuffer(data + b"\xff\xd0", np.uint8).reshape(count, n + 2)
        if (rows[:, :n] > 127).any() or (rows[:, n] != 0xFF).any():
            return False
        for i, p in enumerate(parts):
            p.coef[:, 0] = SEVEN[rows[:, i]] << low
        return True
    if first == 0 or n != 1 or restart:
        return False
    coef, width = parts[0].coef, last - first + 1
    if not high:
        rows = np.frombuffer(data, np.uint8)
        if ac[0] != {(1, 0): 7} or len(rows) != count * width or (rows > 127).any():
            return False
        coef[:, first : last + 1] = SEVEN[rows].reshape(count, width) * (1 << low)
        return True
    plain = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
    if ac[0] != {(1, 0): 0} or width != 63 or len(plain) != count * 8:
        return False
    band = coef[:, 1:]
    bits = np.unpackbits(plain).reshape(count, 64).astype(np.int32)
    if not band.all() or bits[:, 0].any():
        return False
    # a negative coefficient grows downwards: (x ^ -1) - -1 is -x
    sign = band >> 31
    band += ((bits[:, 1:] << low) ^ sign) - sign
    return True


def _read_scan(image: Image, parts: list[Component], dc, ac, first: int, last: int, high: int, low: int, restart: int, data: bytes) -> None:
    if _fast_scan(image, parts, dc, ac, first, last, high, low, restart, data):
        return
    segments = re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data]
    states = [{"pred": 0, "eob": 0} for _ in parts]
    if len(parts) > 1:
        wide = parts[0].wide // parts[0].h
        units = wide * (parts[0].high // parts[0].v)
    else:
        wide = parts[0].own_wide
        units = wide * parts[0].own_high
    bits, nth = None, iter(segments)
    for unit in range(units):
        if bits is None or restart and unit % restart == 0:
            bits = _Bits(next(nth).replace(b"\xff\x00", b"\xff"))
            for s in states:
                s.update(pred=0, eob=0)
        y, x = divmod(unit, wide)
        for p, s, d, a in zip(parts, states, dc, ac, strict=True):
            if len(parts) == 1:
                _slow_block(bits, p.coef[y * p.wide + x], d, a, first, last, high, low, s)
                continue
            for j in range(p.v):
                for i in range(p.h):
                    _slow_block(bits, p.coef[(y * p.v + j) * p.wide + x * p.h + i], d, a, first, last, high, low, s)


def read_coefficients(media: bytes | None) -> Image:
    """Parse a JPEG and accumulate its scans. Null, cut and otherwise bad data
    raise ``ValueError``."""
    if media is None or media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    try:
        return _read_segments(media)
    except (IndexError, KeyError, TypeError, StopIteration, ZeroDivisionError, OverflowError) as why:
        raise ValueError(f"a broken JPEG: {type(why).__name__}") from why


def _read_segments(media: bytes) -> Image:
    """The segments one after the other; scans add to the coefficients."""
    at, restart = 2, 0
    image = Image(0, 0, {}, {}, [])
    tables: dict[tuple[int, int], dict] = {}
    seen = _SEEN_TABLES
    while at + 4 <= len(media):
        if media[at] != 0xFF:
            raise ValueError("marker expected")
        marker = media[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(media[at + 2 : at + 4], "big")
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quants[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                spec = body[1 : 17 + n]
                if spec not in seen:
                    if len(seen) > 64:
                        seen.clear()
                    seen[spec] = _codes(spec[:16], spec[16:])
                tables[body[0] >> 4, body[0] & 15] = seen[spec]
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1, 0xC2):
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for i in range(body[5]):
                c, hv, q = body[6 + 3 * i : 9 + 3 * i]
                image.parts[c] = Component(hv >> 4, hv & 15, q)
            most_h, most_v = max(p.h for p in image.parts.values()), max(p.v for p in image.parts.values())
            across, down = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
            for p in image.parts.values():
                p.wide, p.high = across * p.h, down * p.v
                p.own_wide = -(-(-(-image.width * p.h // most_h)) // 8)
                p.own_high = -(-(-(-image.height * p.v // most_v)) // 8)
                p.coef = np.zeros((p.wide * p.high, 64), np.int32)
        elif marker == 0xDA:
            n = body[0]
            names = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(n)]
            first, last, both = body[1 + 2 * n : 4 + 2 * n]
            end = _HEAD.search(media, at)
            stop = end.start() if end else len(media)
            dc = [tables.get((0, t >> 4), {}) for _, t in names]
            ac = [tables.get((1, t & 15), {}) for _, t in names]
            _read_scan(image, [image.parts[c] for c, _ in names], dc, ac, first, last, both >> 4, both & 15, restart, media[at:stop])
            at = stop
        elif 0xC3 <= marker <= 0xCF:
            raise ValueError(f"unsupported frame {marker:#x}")
    if not image.parts:
        raise ValueError("no frame")
    most_h, most_v = max(p.h for p in image.parts.values()), max(p.v for p in image.parts.values())
    if any(most_h % p.h or most_v % p.v for p in image.parts.values()) or len(image.parts) not in (1, 3):
        raise ValueError("unsupported components")
    if any(len(image.quants[p.quant]) != 64 for p in image.parts.values()):
        raise ValueError("a broken JPEG: quantisation")
    return image


def read_payload(image: Image) -> bytes:
    """The bytes that ``encode`` stored; ``ValueError`` if it wrote no such image."""
    size = next((int(c.split()[1]) for c in image.comments if c.startswith(b"payload ")), None)
    if size is None or set(image.parts) != {1, 2, 3} or len({p.coef.shape for p in image.parts.values()}) > 1:
        raise ValueError("no payload")
    coef = np.stack([image.parts[c].coef for c in (1, 2, 3)], axis=1)
    dc = coef[:, :, 0]
    half = dc >> 1
    out = np.empty(coef.shape, np.uint8)
    sized = np.abs(coef)
    upper = np.where(coef > 0, sized >> 1, 127 - (sized >> 1))
    out[:] = upper << 1 | sized & 1
    out[:, :, 0] = np.where(half > 0, half, half + 127) << 1 | dc & 1
    return out.tobytes()[:size]


def inverse_transform(coef: np.ndarray) -> np.ndarray:
    """Samples (blocks, 8, 8) before the level shift of coefficients (blocks, 64) in natural order.

    Only elementwise steps in a fixed order, so that equal blocks give equal
    samples whatever stands beside them.
    """
    out = np.empty((len(coef), 8, 8), np.float32)
    basis = BASIS.astype(np.float32)

    def one_pass(x: list[np.ndarray]) -> list[np.ndarray]:
        done: list[np.ndarray] = [None] * 8  # type: ignore[list-item]
        for k in range(4):
            even = x[0] * basis[0, k]
            odd = x[1] * basis[1, k]
            for u in (2, 4, 6):
                even += x[u] * basis[u, k]
                odd += x[u + 1] * basis[u + 1, k]
            done[k], done[7 - k] = even + odd, even - odd
        return done

    for i in range(0, len(coef), 512):
        x = np.ascontiguousarray(coef[i : i + 512].T.astype(np.float32)).reshape(8, 8, -1)
        rows = np.stack(one_pass(list(x)))
        cols = one_pass([rows[:, v] for v in range(8)])
        out[i : i + 512] = np.stack(cols, axis=1).transpose(2, 0, 1)
    return out


def planes(image: Image) -> list[np.ndarray]:
    """Each component's samples, 0 to 255, cut to the blocks it covers."""
    out = []
    for p in image.parts.values():
        natural = np.empty_like(p.coef)
        natural[:, ZIGZAG] = p.coef * image.quants[p.quant]
        own = inverse_transform(natural).reshape(p.high, p.wide, 8, 8)
        out.append(np.clip(np.rint(own + 128), 0, 255).transpose(0, 2, 1, 3).reshape(p.high * 8, p.wide * 8))
    return out


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """RGB bytes on a new last axis, by the usual full-range constants."""
    cb, cr = cb - np.float32(128), cr - np.float32(128)
    red = y + np.float32(1.402) * cr
    green = y - np.float32(0.344136) * cb - np.float32(0.714136) * cr
    blue = y + np.float32(1.772) * cb
    return np.stack([np.clip(np.rint(c), 0, 255).astype(np.uint8) for c in (red, green, blue)], axis=-1)


def decode(media: bytes) -> np.ndarray:
    """The RGB tensor (height, width, 3); grey images have three equal channels.

    Subsampled components are repeated to full resolution.
    """
    return rgb_tensor(read_coefficients(media))


def rgb_tensor(image: Image) -> np.ndarray:
    most_h, most_v = max(p.h for p in image.parts.values()), max(p.v for p in image.parts.values())
    full = []
    for p, plane in zip(image.parts.values(), planes(image), strict=True):
        full.append(plane.repeat(most_v // p.v, axis=0).repeat(most_h // p.h, axis=1)[: image.height, : image.width])
    if len(full) == 1:
        return np.repeat(full[0].astype(np.uint8)[..., None], 3, axis=-1)
    return to_rgb(*full[:3])


def rgb_tensors(images: list[Image]) -> list[np.ndarray]:
    """``rgb_tensor`` of each; those of one column of full blocks are worked off together."""
    plain = [i for i, x in enumerate(images) if len(x.parts) == 3 and x.width == 8 and all(p.h * p.v == 1 and x.height == 8 * len(p.coef) for p in x.parts.values())]
    out: list[np.ndarray] = [None] * len(images)  # type: ignore[list-item]
    if plain:
        natural = []
        for c in range(3):
            parts = [list(images[i].parts.values())[c] for i in plain]
            scaled = np.concatenate([p.coef * images[i].quants[p.quant] for i, p in zip(plain, parts, strict=True)])
            turned = np.empty_like(scaled)
            turned[:, ZIGZAG] = scaled
            natural.append(np.clip(np.rint(inverse_transform(turned) + 128), 0, 255).reshape(-1, 8))
        rgb = to_rgb(*natural)
        cuts = np.cumsum([images[i].height for i in plain])[:-1]
        for i, own in zip(plain, np.split(rgb, cuts), strict=True):
            out[i] = own
    return [rgb_tensor(x) if done is None else done for x, done in zip(images, out, strict=True)]


# --- columns ---------------------------------------------------------------

#: Bytes and rows that are worked off together; a longer text is alone.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 256
_DECODED = {
    "doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(), "media_sha256": pa.string(), "height": pa.int32(), "width": pa.int32(), "rgb": pa.binary(), "error": pa.string(),
}
_DECODED_SQL = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, height int, width int, rgb binary, error string"
)


def _slices(sizes: list[int]) -> Iterator[slice]:
    """Runs of rows of bounded size together."""
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and (held + n > SLICE_BYTES or i - begin == SLICE_ROWS):
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def _sizes(column: pa.Array) -> list[int]:
    return pa.compute.binary_length(column).fill_null(0).to_pylist()


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media`` for each row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")
    used = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = _sizes(batch["text"])
            for part in _slices(sizes):
                media = pa.array([encode(pad(batch["text"][i].as_py())) for i in range(part.start, part.stop)], pa.binary())
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(sizes[part], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return used.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_column(media: DataFrame) -> DataFrame:
    """Read the ``media`` of ``encode_column`` back.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, height, width, rgb, error``; ``rgb`` is the
    tensor's bytes, row by row. Null and empty texts give one unit of spaces.
    Null media and those that can't be read have an ``error``, and nulls in
    what isn't known (images of other writers have a tensor but no payload);
    ``error`` is null otherwise. Repeated rows are decoded
    one by one, null ids are kept, an empty table gives no rows.
    """

    def read(stored: bytes | None) -> tuple[Image | None, bytes | None, str | None]:
        image = None
        try:
            image = read_coefficients(stored)
            return image, read_payload(image), None
        except ValueError as why:
            return image, None, str(why)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(_sizes(batch["media"])):
                rows = batch.slice(part.start, part.stop - part.start)
                idents, sizes, media_ = (rows[c].to_pylist() for c in ("doc_id", "n_bytes", "media"))
                found = [read(stored) for stored in media_]
                tensors = iter(rgb_tensors([image for image, _, _ in found if image is not None]))
                out = []
                for ident, size, stored, (image, payload, why) in zip(idents, sizes, media_, found, strict=True):
                    own = (None, None) if stored is None else (len(stored), hashlib.sha256(stored).hexdigest())
                    of_payload = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
                    of_tensor = (None,) * 3
                    if image is not None:
                        rgb = next(tensors)
                        of_tensor = (rgb.shape[0], rgb.shape[1], rgb.tobytes())
                    out.append((ident, size, *of_payload, *own, *of_tensor, why))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _DECODED.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, list(_DECODED))

    return media.mapInArrow(run, _DECODED_SQL)


def with_features(tensors: DataFrame) -> DataFrame:
    """``tensors`` with a ``feature`` of the tensor in place of ``rgb``:
    width and height, and the mean of each channel in thousandths; null
    without a tensor."""
    names = [c for c in tensors.columns if c != "rgb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for rgb, height, width in zip(batch["rgb"], batch["height"].to_pylist(), batch["width"].to_pylist(), strict=True):
                if not rgb.is_valid:
                    found.append(None)
                    continue
                sums = np.frombuffer(rgb.as_buffer(), np.uint8).reshape(-1, 3).sum(axis=0, dtype=np.int64)
                found.append(f"{width}x{height}:" + ",".join(str(int(s) * 1000 // (height * width)) for s in sums))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(found, pa.string())], [*names, "feature"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tensors.schema if f.name != "rgb")
    return tensors.mapInArrow(run, f"{fields}, feature string")


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media are stored as a table and read back; their tensors are a column, of
    which the features are computed."""
    return with_features(decode_column(as_table(encode_column(documents(spark, sf_dir)), "zstd")))
