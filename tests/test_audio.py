"""Audio kernels beside loops over single samples."""

import io
import math
import random
import struct
import wave

import pytest
from pyspark.sql import functions as F

from callweave.functions import audio


def wav(values, rate=1000, wide=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(wide)
        f.setframerate(rate)
        f.writeframes(b"".join((v + 128).to_bytes(1, "little") if wide == 1 else v.to_bytes(wide, "little", signed=True) for v in values))
    return out.getvalue()


def loop(values, rate, silence_ms, threshold_db):
    """The definition: each window's root mean square, one sample after the other; 16-bit values of one channel."""
    ms = round(1000 * len(values) / rate)
    if ms < silence_ms:
        return [(0, ms)] if ms else []
    limit, quiet = 32768 * 10 ** (threshold_db / 20), []
    for i in range(ms - silence_ms + 1):
        part = values[i * rate // 1000 : (i + silence_ms) * rate // 1000]
        if math.isqrt(sum(v * v for v in part) // max(1, len(part))) <= limit:
            quiet.append((i, i + silence_ms))
    merged = []
    for a, b in quiet:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in [*merged, [ms, ms]]:
        if at < a:
            out.append((at, a))
        at = b
    return out


def bursts(r, n, most):
    out = []
    while len(out) < n:
        loud = r.random() < 0.5
        out += [r.randrange(-most, most) if loud else r.randrange(-30, 30) for _ in range(r.randrange(1, n + 1))]
    return out[:n]


@pytest.mark.parametrize("rate, silence_ms, threshold", [(1000, 20, -40.0), (8000, 50, -30.0), (700, 30, -40.0), (11025, 7, -50.0), (1000, 1, -40.0)])
def test_silence_equals_loop(rate, silence_ms, threshold):
    r = random.Random(rate + silence_ms)
    for n in (0, 1, 5, 60, 400, 3000):
        values = bursts(r, n, r.choice([200, 20000])) if n else []
        found = audio.measure(wav(values, rate), silence_ms, threshold)
        assert found[:4] == ("wav", rate, 1, round(1000 * n / rate))
        assert [(x["start_ms"], x["end_ms"]) for x in found[4]] == loop(values, rate, silence_ms, threshold)


def test_pieces_do_not_matter(monkeypatch):
    r = random.Random(2)
    data = wav(bursts(r, 5000, 9000), 8000)
    whole = audio.measure(data, 20, -40.0)
    for n in (1, 7, 64, 4999):
        monkeypatch.setattr(audio, "_AT_ONCE", n)
        assert audio.measure(data, 20, -40.0) == whole


@pytest.mark.parametrize("wide, shift", [(1, -8), (3, 8), (4, 16)])
def test_widths_and_channels(wide, shift):
    r = random.Random(wide)
    values = [v & ~255 for v in bursts(r, 900, 20000)]
    mono = loop(values, 1000, 20, -40.0)
    wider = [v << shift if shift > 0 else v >> -shift for v in values]
    assert [(x["start_ms"], x["end_ms"]) for x in audio.measure(wav(wider, wide=wide), 20, -40.0)[4]] == mono
    left = bursts(r, 900, 20000)
    mixed = [(a + b) // 2 for a, b in zip(values, left, strict=True)]
    found = audio.measure(wav([v for pair in zip(values, left, strict=True) for v in pair], channels=2), 20, -40.0)
    assert found[2] == 2 and [(x["start_ms"], x["end_ms"]) for x in found[4]] == loop(mixed, 1000, 20, -40.0)


def test_loud_and_silent_files():
    assert audio.measure(wav([0] * 900))[3:] == (900, [])
    assert audio.measure(wav([9000] * 900))[4] == [{"start_ms": 0, "end_ms": 900}]
    assert audio.measure(wav([0] * 400))[4] == [{"start_ms": 0, "end_ms": 400}]  # shorter than a window


def test_wave_files_of_other_forms():
    data = wav([7000] * 100)
    extra = data[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + data[12:]
    assert audio.measure(extra)[3] == 100
    cut = audio.measure(data[:-20])
    assert cut[3] == 90
    streamed = data[:40] + struct.pack("<I", 0xFFFFFFFF) + data[44:]
    assert audio.measure(streamed)[3] == 100
    floats = b"RIFF\0\0\0\0WAVE" + struct.pack("<4sIHHIIHH", b"fmt ", 16, 3, 1, 1000, 4000, 4, 32) + b"data" + struct.pack("<I", 2400) + struct.pack("<f", 0.5) * 300 + struct.pack("<f", float("nan")) * 300
    assert audio.measure(floats, 100)[3:] == (600, [{"start_ms": 0, "end_ms": 300}])


def frame(kbits_index=9, rate_index=0, padding=0, version=3, layer=1):
    head = bytes([0xFF, 0xE0 | version << 3 | layer << 1 | 1, kbits_index << 4 | rate_index << 2 | padding << 1, 0])
    size = audio._frame(head, 0)[0]
    return head + b"\0" * (size - 4)


def test_mp3_frames():
    body = frame() * 100 + frame(padding=1) * 50 + frame(kbits_index=5) * 25
    want = round(175 * 1152 * 1000 / 44100)
    assert audio.measure(body) == ("mp3", 44100, 2, want, None)
    tag = b"ID3\x04\0\0" + bytes([0, 0, 3, 9]) + b"\xff\xfb" * 196 + b"\0"
    assert audio.measure(tag + body)[3] == want
    assert audio.measure(tag + body + b"TAG" + b"x" * 125)[3] == want
    assert audio.measure(body[:4177] + b"rubbish" + body[4177:])[3] in (want, want - 26, round(174 * 1152 * 1000 / 44100))
    info = bytearray(frame())
    info[36:40] = b"Xing"
    assert audio.measure(bytes(info) + body)[3] == want
    assert audio.measure(frame(version=2) * 10)[:4] == ("mp3", 22050, 2, round(10 * 576 * 1000 / 22050))
    assert audio.measure(frame(version=2, layer=2) * 4)[3] == round(4 * 1152 * 1000 / 22050)
    assert audio.measure(frame(version=0) * 10)[1] == 11025


def test_flac_and_ogg():
    packed = (48000 << 44 | 1 << 41 | 15 << 36 | 96000).to_bytes(8, "big")
    assert audio.measure(b"fLaC" + b"\0\0\0\x22" + b"\0" * 10 + packed + b"\0" * 16) == ("flac", 48000, 2, 2000, None)
    page = lambda end, body: b"OggS\0\0" + struct.pack("<q", end) + b"\0" * 12 + bytes([1, len(body)]) + body
    opus = b"OpusHead\x01\x02" + struct.pack("<H", 312) + b"\0" * 8
    assert audio.measure(page(0, opus) + page(48000 * 3 + 312, b"x"))[:4] == ("ogg", 48000, 2, 3000)
    vorbis = b"\x01vorbis\0\0\0\0\x01" + struct.pack("<I", 8000) + b"\0" * 14
    assert audio.measure(page(0, vorbis) + page(4000, b"x"))[:4] == ("ogg", 8000, 1, 500)


@pytest.mark.parametrize("data", [None, b"", b"RIFF", b"RIFF\0\0\0\0WAVE", b"RIFF\0\0\0\0WAVEfmt ", b"ID3", b"ID3\x04\0\0\x7f\x7f\x7f\x7f", b"fLaC", b"OggS", b"OggS" + b"\xff" * 30, b"\xff" * 50, b"hello", b"\xff\xfb\x90\x00 one frame alone"])
def test_what_cannot_be_read(data):
    assert audio.measure(data) is None


def test_no_file_crashes():
    r = random.Random(8)
    seeds = [wav([500, -500] * 50), frame() * 5, b"fLaC" + bytes(40), b"OggS" + bytes(60)]
    for _ in range(600):
        data = bytearray(r.choice(seeds))
        for _ in range(r.randrange(1, 6)):
            data[r.randrange(min(60, len(data)))] = r.randrange(256)
        audio.measure(bytes(data[: r.randrange(len(data) + 1)]))


def test_columns(spark):
    files = [wav([0] * 2000 + [9000, -9000] * 500 + [0] * 3000), wav([0] * 900), frame() * 200, None, b"nothing"]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "i int, content binary").withColumn("m", audio.measured(F.col("content")))
    rows = df.select("i", "m.duration_ms", audio.minutes(F.col("m")).alias("minutes"), audio.trimmed(F.col("m")).alias("t")).orderBy("i").collect()
    assert [(r.duration_ms, r.minutes) for r in rows] == [(6000, 0.1), (900, 0.01), (5224, 0.09), (None, None), (None, None)]
    [first] = loop([0] * 2000 + [9000, -9000] * 500 + [0] * 3000, 1000, 500, -40.0)
    assert (rows[0].t.start_ms, rows[0].t.end_ms, rows[0].t.action) == (first[0] - 500, first[1] + 500, "preprocessed")
    assert rows[1].t.action == "all_silence" and [r.t for r in rows[2:]] == [None] * 3


def test_wave_bytes(spark):
    df = spark.createDataFrame([(b"",), (b"abc" * 50,), (bytes(range(256)) * 300,)], "b binary")
    for r in df.select("b", audio.wave_bytes(F.col("b"), 8000).alias("w")).collect():
        with wave.open(io.BytesIO(bytes(r.w))) as f:
            assert (f.getframerate(), f.getsampwidth(), f.readframes(1 << 20)) == (8000, 1, bytes(r.b))
