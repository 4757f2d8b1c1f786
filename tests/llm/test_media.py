import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import awkward, empty, rows
from evigraph.llm import jpeg_media as jm


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1000))
def test_round_trip(data):
    media = jm.encode(jm.pad(data))
    assert jm.read_payload(jm.read_coefficients(media)) == jm.pad(data)


def test_slow_path_agrees(monkeypatch):
    data = jm.pad(bytes(range(256)) + b"\xff" * 400 + "é text ".encode() * 30)
    fast = jm.read_coefficients(jm.encode(data))
    monkeypatch.setattr(jm, "_fast_scan", lambda *a: False)
    slow = jm.read_coefficients(jm.encode(data))
    assert all((fast.parts[c].coef == slow.parts[c].coef).all() for c in (1, 2, 3))


def test_tall_payload():
    data = b"abc" * 64 * (jm.MOST_ROWS + 5)
    image = jm.read_coefficients(jm.encode(data))
    assert image.width == 16 and jm.read_payload(image) == data


class Writer:
    """Bits of a segment, with stuffing."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def number(self, v):
        size = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << size) - 1, size)

    def data(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def progressive(coefs, sampling, width, height, quant):
    """A progressive JPEG with 8-bit codes, runs, ends of bands over several
    blocks, and refinement. coefs[c]: (rows, cols, 64) in zigzag order."""
    table = lambda kind: jm._segment(0xC4, bytes([kind << 4]) + bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255)))
    out = b"\xff\xd8" + jm._segment(0xDB, bytes([0]) + bytes(quant)) + table(0) + table(1)
    out += jm._segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(coefs)]) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling)))
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    for first in (True, False):
        w, pred = Writer(), [0] * len(coefs)
        for y in range(down):
            for x in range(across):
                for c, (h, v) in enumerate(sampling):
                    for j in range(v):
                        for i in range(h):
                            dc = int(coefs[c][y * v + j, x * h + i, 0])
                            if first:
                                diff = (dc >> 1) - pred[c]
                                pred[c] = dc >> 1
                                w.put(abs(diff).bit_length(), 8)
                                if diff:
                                    w.number(diff)
                            else:
                                w.put(dc & 1, 1)
        out += jm._scan([(c + 1, 0) for c in range(len(coefs))], 0, 0, 0 if first else 1, 1 if first else 0, w.data())
    for c, (h, v) in enumerate(sampling):
        own_w, own_h = -(-(-(-width * h // most_h)) // 8), -(-(-(-height * v // most_v)) // 8)
        for lo, hi in ((1, 5), (6, 63)):
            blocks = [coefs[c][y, x] for y in range(own_h) for x in range(own_w)]
            w, eob = Writer(), 0

            def flush(w, eob):
                if eob:
                    n = eob.bit_length() - 1
                    w.put(n << 4, 8)
                    w.put(eob - (1 << n), n)

            for b in blocks:
                run = 0
                for k in range(lo, hi + 1):
                    value = int(b[k]) >> 1 if b[k] >= 0 else -(-int(b[k]) >> 1)
                    if not value:
                        run += 1
                        continue
                    flush(w, eob)
                    eob = 0
                    while run > 15:
                        w.put(0xF0, 8)
                        run -= 16
                    w.put(run << 4 | abs(value).bit_length(), 8)
                    w.number(value)
                    run = 0
                if run:
                    eob += 1
            flush(w, eob)
            out += jm._scan([(c + 1, 0)], lo, hi, 0, 1, w.data())
        w = Writer()
        for b in blocks:
            old = [abs(int(x)) >> 1 for x in b]
            new = [k for k in range(1, 64) if abs(int(b[k])) == 1]
            k = 1
            for n in new:
                run, fix = 0, []
                while True:
                    if old[k]:
                        fix.append(abs(int(b[k])) & 1)
                    elif k == n:
                        break
                    else:
                        run += 1
                        if run == 16:
                            w.put(0xF0, 8)
                            for f in fix:
                                w.put(f, 1)
                            run, fix = 0, []
                    k += 1
                w.put(run << 4 | 1, 8)
                w.put(int(b[n] > 0), 1)
                for f in fix:
                    w.put(f, 1)
                k = n + 1
            if k <= 63:
                w.put(0, 8)
                for x in range(k, 64):
                    if old[x]:
                        w.put(abs(int(b[x])) & 1, 1)
        out += jm._scan([(c + 1, 0)], 1, 63, 1, 0, w.data())
    return out + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_general_progressive(sampling):
    rng = np.random.default_rng(len(sampling) + sampling[0][1])
    width, height = 37, 29
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    coefs = []
    for h, v in sampling:
        c = np.where(rng.random((down * v, across * h, 64)) < 0.15, rng.integers(-9, 10, (down * v, across * h, 64)), 0)
        c[..., 0] = rng.integers(-60, 60, c.shape[:2])
        coefs.append(c)
    quant = [3 + i // 8 for i in range(64)]
    media = progressive(coefs, sampling, width, height, quant)
    image = jm.read_coefficients(media)
    for c, p in enumerate(image.parts.values()):
        got = p.coef.reshape(p.high, p.wide, 64)
        assert (got[..., 0] == coefs[c][..., 0]).all()
        own = np.s_[: p.own_high, : p.own_wide, 1:]
        assert (got[own] == coefs[c][own]).all()
    rgb = jm.decode(media)
    assert rgb.shape == (height, width, 3) and rgb.dtype == np.uint8
    # the same pixels by the definition
    planes = []
    for (h, v), p in zip(sampling, image.parts.values(), strict=True):
        plane = np.zeros((p.high * 8, p.wide * 8))
        for y in range(p.high):
            for x in range(p.wide):
                block = np.zeros(64)
                block[jm.ZIGZAG] = p.coef[y * p.wide + x] * np.array(quant)
                plane[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = jm.BASIS.T @ block.reshape(8, 8) @ jm.BASIS + 128
        planes.append(np.clip(np.rint(plane), 0, 255).repeat(most_v // v, 0).repeat(most_h // h, 1)[:height, :width])
    if len(planes) == 3:
        y, cb, cr = planes
        want = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], -1)
    else:
        want = np.stack([planes[0]] * 3, -1)
    assert np.abs(np.clip(np.rint(want), 0, 255) - rgb).max() <= 2


def test_bad_data():
    with pytest.raises(ValueError):
        jm.decode(b"no image")
    with pytest.raises(ValueError):
        jm.decode(None)


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=500), st.data())
def test_broken_media_raise_value_error_or_are_read(data, draw):
    media = bytearray(jm.encode(jm.pad(data)))
    if draw.draw(st.booleans()):
        media = media[: draw.draw(st.integers(0, len(media) - 1))]
    for _ in range(draw.draw(st.integers(0, 3))):
        if media:
            media[draw.draw(st.integers(0, min(len(media), 150) - 1))] = draw.draw(st.sampled_from([0, 1, 17, 192, 255]))
    if media[100:101] and int.from_bytes(media[:2], "big") == 0xFFD8 and len(media) < 4000:
        try:
            image = jm.read_coefficients(bytes(media))
        except ValueError:
            return
        assert image.parts


def test_broken_media_do_not_stop_the_others(spark):
    good = jm.encode(jm.pad(b"some text"))
    foreign = progressive([np.ones((1, 1, 64), int)], [(1, 1)], 8, 8, [1] * 64)
    media = [(1, 9, good), (2, None, None), (3, 9, good[:200]), (4, 9, b""), (5, 9, foreign), (None, 9, good)]
    df = spark.createDataFrame(media, "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in jm.with_features(jm.decode_column(df)).collect()}
    assert len(got) == 6 and got[1].error is None and got[None].feature == got[1].feature
    assert got[2].media_bytes is None and got[2].error and got[2].feature is None
    assert got[3].media_bytes == 200 and got[4].error and got[4].payload_sha256 is None
    assert got[5].feature.startswith("8x8:") and got[5].payload_bytes is None and got[5].error == "no payload"


def test_slices_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(jm, "SLICE_BYTES", 100)
    monkeypatch.setattr(jm, "SLICE_ROWS", 3)
    sizes = [10, 90, 1, 500, 1, 1, 1, 1, 0]
    parts = list(jm._slices(sizes))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(9))
    assert all(sum(sizes[p]) <= 100 or p.stop - p.start == 1 for p in parts) and max(p.stop - p.start for p in parts) == 3
    assert not list(jm._slices([]))


def expected_pixels(payload):
    """The tensor of a payload of one column, from the definition of the format."""
    data = np.frombuffer(payload, np.uint8).reshape(-1, 3, 64).astype(int)
    half, low = data >> 1, data & 1
    coef = np.where(half >= 64, half * 2 + low, -((127 - half) * 2 + low)).astype(float)
    coef[:, :, 0] = (np.where(half[:, :, 0] >= 64, half[:, :, 0], half[:, :, 0] - 127) << 1) + low[:, :, 0]
    block = np.zeros((len(data), 3, 64))
    block[:, :, jm.ZIGZAG] = coef
    u = np.arange(8)
    basis = np.where(u == 0, np.sqrt(1 / 8), 1 / 2)[:, None] * np.cos((2 * u[None] + 1) * u[:, None] * np.pi / 16)
    plane = np.einsum("ux,ncuv,vy->ncxy", basis, block.reshape(-1, 3, 8, 8), basis) + 128
    y, cb, cr = np.clip(np.rint(plane), 0, 255).transpose(1, 0, 2, 3).reshape(3, -1, 8)
    rgb = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], -1)
    return np.clip(np.rint(rgb), 0, 255)


def test_registered_query(spark, data):
    """Every column against a computation that shares no code with the decoder."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = jm.op4_jpeg_media(spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.error) == (len(raw), len(payload), None)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        media = jm.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        want = expected_pixels(payload)
        size, means = r.feature.split(":")
        assert size == f"8x{len(want)}"
        assert np.abs(np.array(means.split(","), float) / 1000 - want.reshape(-1, 3).mean(axis=0)).max() < 0.02


def test_columns(spark):
    media = jm.encode_column(awkward(spark))
    got = jm.decode_column(media).collect()
    assert len(got) == len(rows())
    by_hash = {}
    for r in rows():
        payload = jm.pad((r[1] or "").encode())
        by_hash[hashlib.sha256(payload).hexdigest()] = (len(payload), zlib.crc32(payload[-16:]))
    for r in got:
        assert by_hash[r.payload_sha256] == (r.payload_bytes, r.tail_crc32)
        assert len(r.rgb) == r.height * r.width * 3
    same = {(r.media_sha256, bytes(r.rgb)) for r in got if r.doc_id == 5}
    assert len(same) == 1
    assert jm.decode_column(jm.encode_column(empty(spark))).count() == 0
