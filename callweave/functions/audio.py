"""Duration and silence from the bytes of audio files.

WAV files hold samples: these become energies of single milliseconds, and prefix sums of
the energies give that of any window, so that a file costs one pass whatever the window
is. Compressed files are not decoded; their duration is read from their own framing: a
walk along MP3 frame headers, FLAC's stream information, the last page of Ogg.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Silence is at least so many milliseconds below so many decibels of full scale.
SILENCE_MS, SILENCE_DB = 500, -40.0

#: Fixed values of MPEG audio, by version (1, or 2 and 2.5) and layer: kilobits a second by
#: the header's index from 1 on; samples a second by version and index; samples of a frame.
_KBITS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

#: Samples that are converted at once.
_AT_ONCE = 1 << 20

MEASURED = "format string, rate int, channels int, duration_ms long, sounding array<struct<start_ms:long,end_ms:long>>"


@dataclass
class Wave:
    """Where the samples of a WAV file are, and what they are."""

    rate: int
    channels: int
    bits: int
    floating: bool
    start: int
    frames: int

    @property
    def duration_ms(self) -> int:
        return round(1000 * self.frames / self.rate)


def read_wave(data: bytes) -> Wave | None:
    """The samples of a WAV file with integer or floating samples, or None.

    Chunks may stand in any order; the data may be shorter than its chunk says, as it is
    when a recording was cut off.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, shape = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        at += 8
        if name == b"fmt " and at + 16 <= len(data):
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at)
            if kind == 0xFFFE and size >= 26 and at + 26 <= len(data):  # the kind is in the extension
                kind = struct.unpack_from("<H", data, at + 24)[0]
            if rate < 1 or channels < 1 or (kind, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}:
                return None
            shape = rate, channels, bits, kind == 3
        elif name == b"data" and shape:
            rate, channels, bits, floating = shape
            return Wave(rate, channels, bits, floating, at, min(size, len(data) - at) // (channels * bits // 8))
        at += size + size % 2
    return None


def samples(data: bytes, wave: Wave, first: int, n: int) -> np.ndarray:
    """n frames from the first on as one channel, the mean rounded down, in 16 bits (as int64)."""
    wide = wave.bits // 8
    raw = np.frombuffer(data, np.uint8, n * wave.channels * wide, wave.start + first * wave.channels * wide)
    if wave.floating:
        values = np.nan_to_num(raw.view(f"<f{wide}").astype(np.float64), nan=0.0, posinf=1.0, neginf=-1.0)
        out = np.floor(np.clip(values, -1.0, 1.0) * 32767).astype(np.int64)
    elif wide == 1:
        out = (raw.astype(np.int64) - 128) << 8
    elif wide == 3:
        out = raw.reshape(-1, 3)[:, 1:].copy().view("<i2").ravel().astype(np.int64)
    else:
        out = raw.view(f"<i{wide}").astype(np.int64) >> (8 * wide - 16)
    return out if wave.channels == 1 else out.reshape(-1, wave.channels).sum(1) // wave.channels


def energies(data: bytes, wave: Wave) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums over milliseconds of the samples' squares and of their number."""
    ms = wave.duration_ms
    bounds = np.minimum(np.arange(ms + 1, dtype=np.int64) * wave.rate // 1000, wave.frames)
    squares = np.zeros(ms + 1, np.int64)
    carried, filled = 0, 0
    for first in range(0, wave.frames, _AT_ONCE):
        n = min(_AT_ONCE, wave.frames - first)
        part = samples(data, wave, first, n)
        sums = np.append(0, np.cumsum(part * part)) + carried
        last = int(np.searchsorted(bounds, first + n, side="right"))
        squares[filled:last] = sums[bounds[filled:last] - first]
        carried, filled = int(sums[-1]), last
    return squares, bounds


def quiet_limit(threshold_db: float = SILENCE_DB) -> int:
    """Mean squares below this are silence: those whose root, rounded down, is not above the threshold."""
    return (math.floor(32768 * 10 ** (threshold_db / 20)) + 1) ** 2


def sounding(data: bytes, wave: Wave, silence_ms: int = SILENCE_MS, threshold_db: float = SILENCE_DB) -> list[tuple[int, int]]:
    """Ranges of milliseconds, end exclusive, that are not silence.

    Silence is each window of silence_ms whose root mean square is at most threshold_db of
    full scale; windows that overlap or touch are one. A file shorter than a window has
    none, so it sounds as a whole; so does a file without silence. Nothing of a silent
    file sounds, nor of an empty one.
    """
    ms = wave.duration_ms
    if ms == 0:
        return []
    if ms < silence_ms:
        return [(0, ms)]
    squares, bounds = energies(data, wave)
    total = squares[silence_ms:] - squares[: ms + 1 - silence_ms]
    number = np.maximum(bounds[silence_ms:] - bounds[: ms + 1 - silence_ms], 1)
    quiet = np.flatnonzero(total < number * quiet_limit(threshold_db))
    if not len(quiet):
        return [(0, ms)]
    new = np.flatnonzero(np.append(True, np.diff(quiet) > silence_ms))
    starts, ends = quiet[new], np.append(quiet[new[1:] - 1], quiet[-1]) + silence_ms
    edges = np.column_stack([np.append(0, ends), np.append(starts, ms)])
    return [(int(a), int(b)) for a, b in edges if a < b]


def _frame(data: bytes, at: int) -> tuple[int, int, int, int] | None:
    """Bytes, samples, samples a second and channels of the MPEG frame at a place, if one is there."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3)
    kbits, rate = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version == 1 or layer == 4 or kbits in (0, 15) or rate == 3:
        return None
    kind, per_second = (1 if version == 3 else 2, layer), _RATES[version][rate]
    padding, n = data[at + 2] >> 1 & 1, _SAMPLES[kind]
    bits = _KBITS[kind][kbits - 1] * 1000
    size = (12 * bits // per_second + padding) * 4 if layer == 1 else n // 8 * bits // per_second + padding
    return size, n, per_second, 1 if data[at + 3] >> 6 == 3 else 2


def mp3_duration(data: bytes) -> tuple[int, int, int] | None:
    """Samples a second, channels and milliseconds of an MP3 file, frame by frame, or None.

    Tags before and after are passed over, as is whatever is no frame. The first frame
    needs a second one, or the end of the file, right after it, since two bytes alone
    may stand anywhere. A first frame that only describes the file has no sound.
    """
    at = 0
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data):
        at += 10 + sum((data[at + 9 - i] & 0x7F) << 7 * i for i in range(4)) + (10 if data[at + 5] & 0x10 else 0)
    shape, seconds, first = None, {}, True
    while 0 <= at < len(data):
        frame = _frame(data, at)
        if frame and shape is None and at + frame[0] != len(data) and not _frame(data, at + frame[0]) and data[at + frame[0] : at + frame[0] + 3] != b"TAG":
            frame = None
        if not frame:
            at = data.find(b"\xff", at + 1)
            continue
        size, n, rate, channels = frame
        shape = shape or (rate, channels)
        if not (first and any(x in data[at : at + min(size, 200)] for x in (b"Xing", b"Info", b"VBRI"))):
            seconds[rate] = seconds.get(rate, 0) + n
        first, at = False, at + size
    return (*shape, round(sum(1000 * n / rate for rate, n in seconds.items()))) if shape else None


def flac_duration(data: bytes) -> tuple[int, int, int] | None:
    if data[:4] != b"fLaC" or len(data) < 26 or data[4] & 0x7F != 0:
        return None
    packed = int.from_bytes(data[18:26], "big")
    rate, channels, n = packed >> 44, (packed >> 41 & 7) + 1, packed & (1 << 36) - 1
    return (rate, channels, round(1000 * n / rate)) if rate and n else None


def ogg_duration(data: bytes) -> tuple[int, int, int] | None:
    """By the place that the last page ends at; Opus counts in 48 kHz, less what it skips."""
    if data[:4] != b"OggS" or len(data) < 28:
        return None
    head, last = data[27 + data[26] :], data.rfind(b"OggS")
    if last + 14 > len(data):
        last = data.rfind(b"OggS", 0, last)
    end = struct.unpack_from("<q", data, last + 6)[0]
    if head[:8] == b"OpusHead" and len(head) >= 12:
        rate, channels, skipped = 48000, head[9], struct.unpack_from("<H", head, 10)[0]
    elif head[:7] == b"\x01vorbis" and len(head) >= 16:
        rate, channels, skipped = struct.unpack_from("<I", head, 12)[0], head[11], 0
    else:
        return None
    return (rate, channels, round(1000 * max(0, end - skipped) / rate)) if rate and end >= 0 else None


def measure(data: bytes | None, silence_ms: int = SILENCE_MS, threshold_db: float = SILENCE_DB) -> tuple | None:
    """(format, rate, channels, duration_ms, sounding) of a file; None where it cannot be read.

    sounding is None for compressed files, whose samples are not decoded.
    """
    data = bytes(data or b"")
    try:
        if wave := read_wave(data):
            return "wav", wave.rate, wave.channels, wave.duration_ms, [{"start_ms": a, "end_ms": b} for a, b in sounding(data, wave, silence_ms, threshold_db)]
        for name, find in (("flac", flac_duration), ("ogg", ogg_duration)):
            if found := find(data):
                return name, *found, None
        found = mp3_duration(data) if data[:4] not in (b"RIFF", b"fLaC", b"OggS") else None
        return ("mp3", *found, None) if found else None
    except (struct.error, IndexError, OverflowError):  # cut off within a header
        return None


def measured(content: Column, silence_ms: int = SILENCE_MS, threshold_db: float = SILENCE_DB) -> Column:
    """struct(format, rate, channels, duration_ms, sounding) of a file's bytes; its fields are
    null for what is no audio file that can be read, and for null."""

    @F.pandas_udf(MEASURED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = [measure(f, silence_ms, threshold_db) or (None,) * 5 for f in files]
            out = pd.DataFrame(rows, columns=["format", "rate", "channels", "duration_ms", "sounding"], dtype=object)
            for c in ("rate", "channels", "duration_ms"):
                out[c] = out[c].astype("Int64")
            yield out

    return run(content)


def minutes(found: Column) -> Column:
    """Minutes, to two places, of what measured() gives; null where it could not be read."""
    from .numbers import minutes_of

    return minutes_of(found["duration_ms"])


def trimmed(found: Column, padding: int = 500, least_pct: float = 5.0) -> Column:
    """edge_trim() by what sounds in a file; null for files whose samples are not known."""
    from .text import edge_trim

    ranges = found["sounding"]
    cut = edge_trim(found["duration_ms"], F.get(ranges, 0)["start_ms"], F.get(ranges, F.size(ranges) - 1)["end_ms"], padding, least_pct)
    return F.when(ranges.isNotNull(), cut)


def wave_bytes(payload: Column, rate: int, bits: int = 8, channels: int = 1) -> Column:
    """A WAV file whose samples are a binary column's bytes."""
    little = lambda n: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)]))
    size = F.octet_length(payload)
    wide = channels * bits // 8
    shape = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * wide, wide, bits) + b"data"
    return F.concat(F.lit(b"RIFF"), little(size + 36), F.lit(b"WAVE" + shape), little(size), payload)
