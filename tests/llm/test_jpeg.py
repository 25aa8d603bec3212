import hashlib
import itertools
import math
import struct
import zlib

import numpy as np
import pytest

from callweave.llm import jpeg


def slow_encode(width, height, sampling, coefficients, script, quant=1, restart=0):
    """A plain progressive encoder, code by code. script: (components, ss, se, ah, al)."""
    frame = struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    image = jpeg._frame(frame)
    out = [b"\xff\xd8", jpeg._segment(0xDB, bytes([0]) + bytes([quant]) * 64), jpeg._segment(0xC2, frame)]
    if restart:
        out.append(jpeg._segment(0xDD, struct.pack(">H", restart)))
    for parts, ss, se, ah, al in script:
        orders = [jpeg._order(image.components[p], len(parts) == 1) for p in parts]
        intervals, tokens, last = [], [], [0] * len(parts)
        for mcu in range(len(orders[0])):
            if restart and mcu and mcu % restart == 0:
                intervals.append(tokens)
                tokens, last = [], [0] * len(parts)
            for k, p in enumerate(parts):
                for b in orders[k][mcu]:
                    block = coefficients[p][b].tolist()
                    if ss == 0 and not ah:
                        v = block[0] >> al
                        d, last[k] = v - last[k], v
                        n = abs(d).bit_length()
                        tokens += [("s", n), ("b", d if d >= 0 else d + (1 << n) - 1, n)]
                    elif ss == 0:
                        tokens.append(("b", block[0] >> al & 1, 1))
                    else:
                        tokens += ac(block, ss, se, ah, al)
        intervals.append(tokens)
        symbols = sorted({t[1] for ts in intervals for t in ts if t[0] == "s"})
        n = max(1, math.ceil(math.log2(len(symbols) + 1)))
        code = {s: i for i, s in enumerate(symbols)}
        if symbols:
            counts = [0] * 16
            counts[n - 1] = len(symbols)
            out.append(jpeg._segment(0xC4, bytes([0x10 if ss else 0, *counts, *symbols])))
        out.append(jpeg._segment(0xDA, bytes([len(parts), *(x for p in parts for x in (p + 1, 0)), ss, se, ah << 4 | al])))
        for i, ts in enumerate(intervals):
            bits = "".join(format(code[t[1]], f"0{n}b") if t[0] == "s" else format(t[1], f"0{t[2]}b") if t[2] else "" for t in ts)
            if i:
                out.append(bytes([0xFF, 0xD0 + (i - 1) % 8]))
            out.append(jpeg._packed(np.array(list(bits), np.uint8)) if bits else b"")
    return b"".join([*out, b"\xff\xd9"])


def ac(block, ss, se, ah, al):
    size = [abs(c) >> al for c in block]
    out, run, held = [], 0, []
    last = max((k for k in range(ss, se + 1) if size[k] == 1), default=0)
    for k in range(ss, se + 1):
        if not size[k]:
            run += 1
            continue
        if ah:
            while run > 15 and k <= last:
                out += [("s", 0xF0), *held]
                held, run = [], run - 16
            if size[k] > 1:
                held.append(("b", size[k] & 1, 1))
                continue
            out += [("s", run << 4 | 1), ("b", int(block[k] > 0), 1), *held]
            held, run = [], 0
        else:
            while run > 15:
                out.append(("s", 0xF0))
                run -= 16
            n = size[k].bit_length()
            out += [("s", run << 4 | n), ("b", size[k] if block[k] > 0 else (1 << n) - 1 - size[k], n)]
            run = 0
    return [*out, ("s", 0), *held] if run or held else out


SCRIPT3 = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((2,), 1, 63, 0, 1), ((1,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2), ((0,), 1, 63, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((2,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0)]


@pytest.mark.parametrize(
    ("width", "height", "sampling", "restart"),
    [(35, 21, [(2, 2), (1, 1), (1, 1)], 0), (16, 16, [(1, 1), (1, 1), (1, 1)], 2), (50, 9, [(2, 1), (1, 1), (1, 1)], 0), (17, 30, [(1, 2), (1, 1), (1, 1)], 3)],
)
def test_any_progressive_file_is_decoded(width, height, sampling, restart):
    rng = np.random.default_rng(width)
    frame = struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    coefficients = []
    for c in jpeg._frame(frame).components:
        x = rng.integers(-40, 41, c.blocks.shape) * (rng.random(c.blocks.shape) < 0.2)
        own = np.zeros(len(x), bool)  # blocks that only fill MCUs carry no AC values
        own[jpeg._order(c, True).ravel()] = True
        x[~own, 1:] = 0
        coefficients.append(x.astype(np.int16))
    image = jpeg.read(slow_encode(width, height, sampling, coefficients, SCRIPT3, 3, restart))
    for c, x in zip(image.components, coefficients, strict=True):
        assert (c.blocks == x).all()
    rgb = jpeg.tensor(image)
    assert rgb.shape == (height, width, 3)
    # the inverse transform and the upsampling, one pixel at a time
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    for y, x in [(0, 0), (height - 1, width - 1), (height // 2, width // 3)]:
        values = []
        for c, co in zip(image.components, coefficients, strict=True):
            py, px = y * c.v // vm, x * c.h // hm
            block = co[(py // 8) * c.cols + px // 8].astype(float) * 3
            total = 0.0
            for k in range(64):
                r, q = divmod(int(jpeg.ZIGZAG[k]), 8)
                total += block[k] * (math.sqrt(0.5) if r == 0 else 1) * (math.sqrt(0.5) if q == 0 else 1) / 4 * math.cos((2 * (py % 8) + 1) * r * math.pi / 16) * math.cos((2 * (px % 8) + 1) * q * math.pi / 16)
            values.append(min(127, max(-128, total)))
        lum, cb, cr = values
        want = [min(255, max(0, v)) for v in (lum + 128 + 1.402 * cr, lum + 128 - 0.344136 * cb - 0.714136 * cr, lum + 128 + 1.772 * cb)]
        assert np.abs(rgb[y, x] - np.array(want)).max() <= 2


def test_grey_file():
    rng = np.random.default_rng(1)
    x = (rng.integers(-9, 10, (6, 64)) * (rng.random((6, 64)) < 0.3)).astype(np.int16)
    image = jpeg.read(slow_encode(24, 16, [(1, 1)], [x], [((0,), 0, 0, 0, 0), ((0,), 1, 63, 0, 1), ((0,), 1, 63, 1, 0)]))
    assert (image.components[0].blocks == x).all() and jpeg.tensor(image).shape == (16, 24, 3)


@pytest.mark.parametrize("n", [192, 384, 576, 192 * 17, 192 * 1001, 192 * 70_000])
def test_payloads_come_back(n):
    raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    assert jpeg.load(jpeg.store(raw)) == raw
    assert jpeg.load(jpeg.store(b"\xff" * n)) == b"\xff" * n


def test_padding():
    assert jpeg.padded(None) == jpeg.padded("") == b" " * 192
    assert len(jpeg.padded("x" * 192)) == 192 and len(jpeg.padded("é" * 100)) == 384


def test_no_jpeg():
    with pytest.raises(ValueError):
        jpeg.decode(b"GIF89a")


def test_digests(spark):
    texts = ["", None, "a", "é" * 500, "x" * 192, "long " * 60_000, "a"]
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = {r.doc_id: r for r in jpeg.digests(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = jpeg.store(payload)
        assert bytes(r.media) == media and jpeg.load(media) == payload
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        rgb = jpeg.decode(media)
        assert (r.height, r.width, 3) == rgb.shape and bytes(r.rgb) == rgb.tobytes()
        pixels = [[tuple(int(v) for v in bytes(r.rgb)[3 * (y * r.width + x) :][:3]) for x in range(r.width)] for y in range(r.height)] if len(raw) < 2000 else None
        if pixels:
            sums = [sum(p[c] for row in pixels for p in row) for c in range(3)]
            steps = sum(abs(a[1] - b[1]) for row in pixels for a, b in itertools.pairwise(row))
            assert r.feature == ":".join(map(str, (r.height, r.width, *sums, steps)))
    assert rows[2].media_sha256 == rows[6].media_sha256
    assert jpeg.digests(df.limit(0)).count() == 0


def test_media_and_tensor_columns(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in jpeg.tensors(jpeg.stored(df)).collect()}
    assert (rows[1].height, rows[1].width, len(rows[1].rgb)) == (16, 16, 768)
    nulls = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert jpeg.tensors(nulls).first().rgb is None
