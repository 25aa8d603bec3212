"""Progressive JPEG in numpy: scans into coefficients, coefficients into RGB tensors.

decode() accepts progressive files (SOF2) of one or three components with any sampling
factors, restart intervals and scan scripts: spectral-selection and successive-
approximation scans are accumulated into coefficient arrays, which are de-quantised,
inverse-transformed, upsampled and turned into RGB. Where a scan has a fixed layout (a
Huffman table with one code) or raw bits (refinement), whole scans are read as arrays;
the other scans are read code by code.

store() keeps arbitrary bytes in such a file without loss. JPEG's own unit is the
quantised coefficient, so a byte becomes a coefficient: 64 bytes a block, three blocks
or more, dealt over a 4:2:0 image. A block's first byte is its DC value, sent as eight
single-bit refinement scans; the others become AC values of eight bits (b >= 128 as b,
smaller ones as b - 255), sent as a first scan of seven bits and one refinement scan.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

UNIT = 192  # bytes: a block of each of three components

_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _zigzag() -> np.ndarray:
    """Natural index (8 * row + column) of each place in zigzag order."""
    cells = sorted(((r + c, (r if (r + c) % 2 else c), r, c) for r in range(8) for c in range(8)))
    return np.array([8 * r + c for _, _, r, c in cells])


def _inverse() -> np.ndarray:
    """64 x 64 matrix from coefficients in zigzag order to samples in raster order."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    a = np.where(k == 0, math.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * math.pi / 16)
    full = np.einsum("ur,vc->uvrc", a, a).reshape(64, 64)
    return full[ZIGZAG].astype(np.float32)


ZIGZAG = _zigzag()
INVERSE = _inverse()


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks that the component itself has
    high: int = 0
    cols: int = 0  # blocks with those that fill whole MCUs
    rows: int = 0
    blocks: np.ndarray = field(default=None, repr=False)  # (rows * cols, 64) in zigzag order


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comment: bytes = b""


class Table:
    """A Huffman table: code lengths and symbols; look-up by the next 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.single = (counts.index(1) + 1, symbols[0]) if len(symbols) == 1 else None
        self.counts, self.symbols, self._find = counts, symbols, None

    @property
    def find(self) -> tuple[list[int], list[int]]:
        if self._find is None:
            length, symbol, code, k = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8), 0, 0
            for n, count in enumerate(self.counts, 1):
                for _ in range(count):
                    at = slice(code << (16 - n), (code + 1) << (16 - n))
                    length[at], symbol[at] = n, self.symbols[k]
                    code, k = code + 1, k + 1
                code <<= 1
            self._find = (length.tolist(), symbol.tolist())
        return self._find


class Bits:
    """Entropy-coded bits of one restart interval."""

    def __init__(self, data: bytes):
        self.data, self.at = data.replace(b"\xff\x00", b"\xff"), 0
        self._bits = self._next = None

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(np.frombuffer(self.data, np.uint8))
        return self._bits

    def code(self, table: Table) -> int:
        if self._next is None:
            raw = np.frombuffer(self.data + b"\xff\xff\xff\xff", np.uint8).astype(np.uint32)
            three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
            self._next = (three[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)[None, :] & 0xFFFF).ravel().tolist()
        length, symbol = table.find
        window = self._next[self.at]
        if not length[window]:
            raise ValueError("the scan holds a code that its table lacks")
        self.at += length[window]
        return symbol[window]

    def number(self, n: int) -> int:
        """The next n bits as an unsigned number."""
        if not n:
            return 0
        self.at += n
        first, last = (self.at - n) // 8, (self.at + 7) // 8
        return int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at) & ((1 << n) - 1)

    def array(self, n: int) -> np.ndarray:
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the scan ends too early")
        return self.bits[self.at - n : self.at]


def _extend(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def read(data: bytes) -> Image:
    """The coefficients of a progressive JPEG file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    image, tables, quants, restart, comment, at = None, {}, {}, 0, b"", 2
    while True:
        marker, at = data[at + 1], at + 2
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at)[0]
        body, at = data[at + 2 : at + size], at + size
        if marker == 0xC2:
            image = _frame(body)
        elif marker in (0xC0, 0xC1, 0xC3):
            raise ValueError("no progressive JPEG file")
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = Table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            end = _MARKER.search(data, at).start()
            _scan(image, body, tables, data[at:end], restart)
            at = end
    image.quants, image.comment = quants, comment
    return image


def _frame(body: bytes) -> Image:
    _, height, width, n = struct.unpack_from(">BHHB", body)
    parts = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
    h, v = max(c.h for c in parts), max(c.v for c in parts)
    for c in parts:
        c.wide, c.high = -(-width * c.h // (8 * h)), -(-height * c.v // (8 * v))
        c.cols, c.rows = -(-width // (8 * h)) * c.h, -(-height // (8 * v)) * c.v
        c.blocks = np.zeros((c.rows * c.cols, 64), np.int16)
    return Image(width, height, parts, {})


def _order(c: Component, alone: bool) -> np.ndarray:
    """Indices of a component's blocks, a row for each MCU of the scan."""
    if alone:
        return (np.arange(c.high)[:, None] * c.cols + np.arange(c.wide)[None, :]).reshape(-1, 1)
    return np.arange(c.rows * c.cols).reshape(c.rows // c.v, c.v, c.cols // c.h, c.h).transpose(0, 2, 1, 3).reshape(-1, c.v * c.h)


def _scan(image: Image, body: bytes, tables: dict[int, Table], data: bytes, restart: int) -> None:
    n = body[0]
    parts = [(next(c for c in image.components if c.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
    first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    orders = [_order(c, n == 1) for c, _ in parts]
    pieces = re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data]
    step = restart or len(orders[0])
    for i, piece in enumerate(pieces):
        bits, own = Bits(piece), [o[i * step : (i + 1) * step] for o in orders]
        if first == 0 and not high:
            _dc_first(parts, own, tables, bits, low)
        elif first == 0:
            _dc_refine(parts, own, bits, low)
        elif not high:
            _ac_first(parts[0][0].blocks, own[0].ravel(), tables[0x10 | parts[0][1] & 15], bits, first, last, low)
        else:
            _ac_refine(parts[0][0].blocks, own[0].ravel(), tables[0x10 | parts[0][1] & 15], bits, first, last, low)


def _dc_first(parts, orders, tables, bits: Bits, low: int) -> None:
    own = [tables[t >> 4] for _, t in parts]
    if all(t.single and t.single[1] == 0 for t in own):
        return  # every difference is zero
    last = [0] * len(parts)
    for mcu in range(len(orders[0])):
        for k, (c, _) in enumerate(parts):
            for block in orders[k][mcu]:
                size = bits.code(own[k])
                last[k] += _extend(bits.number(size), size)
                c.blocks[block, 0] = last[k] << low


def _dc_refine(parts, orders, bits: Bits, low: int) -> None:
    widths = [o.shape[1] for o in orders]
    got = bits.array(len(orders[0]) * sum(widths)).reshape(len(orders[0]), -1).astype(np.int16) << low
    at = 0
    for (c, _), order, w in zip(parts, orders, widths, strict=True):
        c.blocks[order.ravel(), 0] |= got[:, at : at + w].ravel()
        at += w


def _ac_first(blocks: np.ndarray, order: np.ndarray, table: Table, bits: Bits, first: int, last: int, low: int) -> None:
    band = last - first + 1
    if table.single and table.single[1] >> 4 == 0 and (size := table.single[1] & 15):
        length = table.single[0] + size
        if length == 8 and size == 7:
            got = np.frombuffer(bits.data, np.uint8, len(order) * band).astype(np.int16)
        else:
            raw = bits.array(len(order) * band * length).reshape(-1, length)[:, table.single[0] :]
            got = raw.astype(np.int16) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int16))
        value = np.where(got >> (size - 1), got, got - ((1 << size) - 1))
        blocks[order, first : last + 1] = (value << low).reshape(-1, band)
        return
    run = 0
    for block in order:
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            symbol = bits.code(table)
            skip, size = symbol >> 4, symbol & 15
            if size:
                k += skip
                blocks[block, k] = _extend(bits.number(size), size) * (1 << low)
                k += 1
            elif skip == 15:
                k += 16
            else:
                run = (1 << skip) + bits.number(skip) - 1
                break


def _correct(blocks: np.ndarray, rows, places, raw: np.ndarray, low: int) -> None:
    """Add a correction bit to the magnitude of coefficients that are not zero."""
    old = blocks[rows, places]
    blocks[rows, places] = old + np.sign(old) * (raw.astype(np.int16) << low)


def _ac_refine(blocks: np.ndarray, order: np.ndarray, table: Table, bits: Bits, first: int, last: int, low: int) -> None:
    i = 0
    while i < len(order):
        block, k = order[i], first
        while k <= last:
            symbol = bits.code(table) if table.single is None else _only(table, bits)
            skip, size = symbol >> 4, symbol & 15
            if not size and skip < 15:  # the rest of this block and of the run: correction bits alone
                run = (1 << skip) + bits.number(skip)
                rest = np.flatnonzero(blocks[block, k : last + 1]) + k
                _correct(blocks, block, rest, bits.array(len(rest)), low)
                rows = order[i + 1 : i + run]
                if len(rows):
                    there = blocks[rows, first : last + 1] != 0
                    if there.all():
                        old = blocks[rows, first : last + 1]
                        blocks[rows, first : last + 1] = old + np.sign(old) * (bits.array(old.size).reshape(old.shape).astype(np.int16) << low)
                    else:
                        r, c = np.nonzero(there)
                        _correct(blocks, rows[r], c + first, bits.array(len(r)), low)
                i += run - 1
                break
            new = (1 if bits.number(1) else -1) << low if size else 0
            while k <= last:
                if blocks[block, k]:
                    if bits.number(1):
                        blocks[block, k] += (1 << low) * (1 if blocks[block, k] > 0 else -1)
                elif skip:
                    skip -= 1
                else:
                    break
                k += 1
            if size:
                blocks[block, k] = new
            k += 1
        i += 1


def _only(table: Table, bits: Bits) -> int:
    bits.at += table.single[0]
    return table.single[1]


def tensor(image: Image) -> np.ndarray:
    """(height, width, 3) uint8 RGB of an image's coefficients, chroma repeated to full size."""
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        samples = (c.blocks * image.quants[c.quant][None, :]).astype(np.float32) @ INVERSE
        plane = samples.reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.cols * 8)
        plane = np.clip(np.rint(plane), -128, 127)
        if h // c.h > 1:
            plane = np.repeat(plane, h // c.h, axis=1)
        if v // c.v > 1:
            plane = np.repeat(plane, v // c.v, axis=0)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        grey = (planes[0] + 128).astype(np.uint8)
        return np.repeat(grey[:, :, None], 3, axis=2)
    y, cb, cr = planes
    y = y + 128
    rgb = np.empty((image.height, image.width, 3), np.float32)
    rgb[:, :, 0] = y + 1.402 * cr
    rgb[:, :, 1] = y - 0.344136 * cb - 0.714136 * cr
    rgb[:, :, 2] = y + 1.772 * cb
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    return tensor(read(data))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(ident: int, symbols: list[int]) -> bytes:
    """A table whose symbols have codes 0, 10, 110 ... in the order given."""
    return _segment(0xC4, bytes([ident, *([1] * len(symbols) + [0] * (16 - len(symbols))), *symbols]))


def _packed(bits: np.ndarray) -> bytes:
    """Bits filled up with ones, with a zero byte after each FF."""
    fill = np.ones(-len(bits) % 8, np.uint8)
    return np.packbits(np.concatenate((bits, fill))).tobytes().replace(b"\xff", b"\xff\x00")


def _sos(idents: list[int], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(idents), *(x for i in idents for x in (i, 0)), first, last, high << 4 | low]))


def store(payload: bytes) -> bytes:
    """payload in a progressive JPEG file; load() gives it back."""
    blocks = -(-len(payload) // 64)
    wide = 2 * max(1, math.ceil(math.sqrt(blocks / 6)))
    high = 2 * max(1, -(-blocks // (3 * wide)))
    counts = [wide * high, wide * high // 4, wide * high // 4]
    raw = np.zeros((sum(counts), 64), np.uint8)
    raw.ravel()[: len(payload)] = np.frombuffer(payload, np.uint8)
    luma = np.arange(counts[0]).reshape(high // 2, 2, wide // 2, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    chroma = counts[0] + np.arange(counts[1])[:, None]
    dc = raw[np.concatenate((luma, chroma, chroma + counts[1]), axis=1).ravel(), 0]  # in MCU order

    ac = raw[:, 1:]
    size = np.where(ac >= 128, ac, 255 - ac)
    top = np.where(ac >= 128, size >> 1, 127 - (size >> 1)).astype(np.uint8)  # under one code of one bit: whole bytes
    bits = size & 1

    out = [
        b"\xff\xd8",
        _segment(0xFE, str(len(payload)).encode()),
        _segment(0xDB, bytes([0]) + bytes([1]) * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _huffman(0x00, [0]),
        _sos([1, 2, 3], 0, 0, 0, 8) + _packed(np.zeros(len(dc), np.uint8)),
        *(_sos([1, 2, 3], 0, 0, low + 1, low) + _packed(dc >> low & 1) for low in range(7, -1, -1)),
        _huffman(0x10, [0x07]),
    ]
    ends = np.cumsum(counts)
    for ident, n, end in zip((1, 2, 3), counts, ends, strict=True):
        out.append(_sos([ident], 1, 63, 0, 1) + top[end - n : end].tobytes())
    for ident, n, end in zip((1, 2, 3), counts, ends, strict=True):
        runs = [min(32767, n - i) for i in range(0, n, 32767)]
        kinds = sorted({r.bit_length() - 1 for r in runs})
        parts, at = [], end - n
        for r in runs:
            kind = r.bit_length() - 1
            head = [1] * kinds.index(kind) + [0] + [r >> b & 1 for b in range(kind - 1, -1, -1)]
            parts += [np.array(head, np.uint8), bits[at : at + r].ravel()]
            at += r
        out += [_huffman(0x10, [k << 4 for k in kinds]), _sos([ident], 1, 63, 1, 0) + _packed(np.concatenate(parts))]
    return b"".join([*out, b"\xff\xd9"])


def payload_of(image: Image) -> bytes:
    """The bytes that store() kept as coefficients."""
    raw = np.concatenate([c.blocks for c in image.components])
    raw[:, 1:] += np.where(raw[:, 1:] < 0, np.int16(255), np.int16(0))
    return raw.astype(np.uint8).tobytes()[: int(image.comment)]


def load(data: bytes) -> bytes:
    return payload_of(read(data))


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


def feature(rgb: np.ndarray) -> str:
    """Size, sum of each channel, and sum of the steps between neighbours in a row."""
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    steps = np.abs(np.diff(rgb[:, :, 1].astype(np.int16), axis=1)).sum(dtype=np.int64)
    return ":".join(map(str, (rgb.shape[0], rgb.shape[1], *sums, steps)))


def _run(df: DataFrame, fields: str, row, column: str) -> DataFrame:
    """df's other columns, and those that row(value) makes of a column."""
    bounded_batches(df.sparkSession)
    names = [f.split()[0] for f in fields.split(", ")]
    kept = [c for c in df.columns if c != column and c not in names]
    df = df.select(*[df[f"`{c}`"] for c in [*kept, column]])
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 16  # rows whose files and tensors are in memory together
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                made = list(zip(*map(row, part.column(len(kept)).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *map(pa.array, made, types)], names=[*kept, *names])

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields[: len(kept)])
    return df.mapInArrow(run, ddl + fields)


def stored(df: DataFrame, column: str = "text") -> DataFrame:
    """df without its text column, and media binary: the padded text in a JPEG file.

    A null text counts as empty; an empty one is stored as 192 blanks.
    """
    return _run(df, "media binary", lambda text: (store(padded(text)),), column)


def tensors(df: DataFrame, column: str = "media") -> DataFrame:
    """df without its column of progressive JPEG files, and height, width and rgb.

    rgb holds height x width x 3 bytes, row by row. Null files give nulls; files that
    are no progressive JPEG raise an error.
    """

    def row(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None
        rgb = decode(data)
        return rgb.shape[0], rgb.shape[1], rgb.tobytes()

    return _run(df, "height int, width int, rgb binary", row, column)


FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, height int, width int, rgb binary"


def digests(df: DataFrame, column: str = "text") -> DataFrame:
    """Stores each text in a file, reads it back, and describes both; with the file (media) and
    the full-resolution tensor (height x width x 3 bytes in rgb).

    A null text counts as empty, and an empty one is stored as 192 blanks. Equal texts have
    equal values, repeated rows give repeated results, an empty table gives no rows. Other
    columns of df stay, but those of a result's name.
    """

    def row(text: str | None) -> tuple:
        media = store(padded(text))
        image = read(media)
        payload, rgb = payload_of(image), tensor(image)
        return (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(rgb), media, *rgb.shape[:2], rgb.tobytes())

    return _run(df, FIELDS, row, column)
