"""Spreadsheets written by tasks: each makes compressed pieces of a sheet's rows, a commit joins them.

A sheet's rows are XML in a deflate stream. Streams that are flushed to a byte boundary can
follow each other, and checksums of pieces give that of the whole, so the parts of all
tasks become one entry of the workbook's archive without being unpacked. The driver gets a
few numbers for each part. A task that fails leaves its piece in a folder that goes.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from datetime import date, datetime
from decimal import Decimal
from xml.sax.saxutils import escape, quoteattr

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import joined

#: Fixed values of the format: rows of a sheet with the headings, characters of a cell and of a sheet's name.
SHEET_ROWS, CELL_CHARS, NAME_CHARS = 1 << 20, 32_767, 31
#: Rows of a part; a sheet ends between two parts.
PART_ROWS = 50_000

_NOT_IN_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|_x[0-9A-Fa-f]{4}_")
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def cell(value: object) -> str:
    """A value as a cell: numbers and truth values as such, all else as text, null as empty."""
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, Decimal)) or isinstance(value, float) and value - value == 0:
        return f"<c><v>{value!r}</v></c>" if not isinstance(value, Decimal) else f"<c><v>{value}</v></c>"
    if isinstance(value, (date, datetime)):
        value = value.isoformat()
    elif not isinstance(value, str):
        value = json.dumps(value, ensure_ascii=False, default=str)
    if len(value) > CELL_CHARS:
        raise ValueError(f"a cell holds at most {CELL_CHARS} characters, not {len(value)}")
    text = _NOT_IN_XML.sub(lambda m: "".join(f"_x{ord(c):04X}_" for c in m[0][:1]) + m[0][1:], value)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text, {chr(13): "_x000D_"})}</t></is></c>'


def row(values: object) -> str:
    return f"<row>{''.join(map(cell, values))}</row>"


@dataclass
class Part(WriterCommitMessage):
    """What the driver gets to know of the pieces of a task: files, rows, bytes packed and not, checksums."""

    order: int
    files: list[tuple[str, int, int, int, int]]


def packed(data: bytes, last: bool = False) -> bytes:
    """data as a piece of a deflate stream, on a byte boundary; the last one ends it."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    return squeeze.compress(data) + squeeze.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


def crc_of_both(first: int, second: int, n: int) -> int:
    """The CRC-32 of two byte strings after each other, from those of both and the second one's length."""

    def times(matrix: list[int], x: int) -> int:
        out = 0
        for i in range(32):
            if x >> i & 1:
                out ^= matrix[i]
        return out

    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):  # one zero byte
        step = [times(step, x) for x in step]
    while n:
        if n & 1:
            first = times(step, first)
        step, n = [times(step, x) for x in step], n >> 1
    return first ^ second


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def _files(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if re.match(r"[a-z0-9]+:", self.path) else (pafs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator) -> Part:
        fs, root = self._files()
        fs.create_dir(root, recursive=True)
        files, some, order = [], [], TaskContext.get().partitionId()

        def flush() -> None:
            data = "".join(some).encode()
            name, piece = f"{root}/piece-{order:06}-{len(files):06}-{uuid.uuid4().hex}", packed(data)
            with fs.open_output_stream(name) as out:
                out.write(piece)
            files.append((name.rsplit("/", 1)[1], len(some), len(piece), len(data), zlib.crc32(data)))
            some.clear()

        for values in iterator:
            some.append(row(values))
            if len(some) >= PART_ROWS:
                flush()
        if some:
            flush()
        return Part(order, files)

    def commit(self, messages: list[Part]) -> None:
        fs, root = self._files()
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps([asdict(m) for m in sorted((m for m in messages if m), key=lambda m: m.order)]).encode())

    def abort(self, messages: list[Part]) -> None:
        fs, root = self._files()
        fs.delete_dir_contents(root, missing_dir_ok=True)


class SheetParts(DataSource):
    """A sink for the rows of one sheet, in the folder named by the option path."""

    @classmethod
    def name(cls) -> str:
        return "sheetparts"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def _entry(name: str, crc: int, packed_size: int, size: int, at: int) -> tuple[bytes, bytes]:
    """The headers of an archive's entry, before it and in the directory; sizes may be beyond 4 GB."""
    raw = name.encode()
    wide = struct.pack("<HHQQ", 1, 16, size, packed_size)
    before = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 8, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(wide)) + raw + wide
    wide = struct.pack("<HHQQQ", 1, 24, size, packed_size, at)
    listed = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 8, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + raw + wide
    return before, listed


def _archive(entries: list[tuple[str, list[tuple[joined.Piece, int, int, int]]]]) -> list[joined.Piece]:
    """Pieces of an archive of entries, each of pieces (bytes or file, packed size, size, checksum)."""
    out: list[joined.Piece] = []
    directory, at = b"", 0
    for name, pieces in entries:
        crc = size = length = 0
        for _, n, m, c in pieces:
            crc, size, length = crc_of_both(crc, c, m), size + m, length + n
        before, listed = _entry(name, crc, length, size, at)
        out += [before, *(p for p, *_ in pieces)]
        directory += listed
        at += len(before) + length
    end = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, len(entries), len(entries), len(directory), at)
    end += struct.pack("<4sIQI", b"PK\6\7", 0, at + len(directory), 1)
    end += struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return [*out, directory + end]


def _piece(text: str, last: bool = False) -> tuple[bytes, int, int, int]:
    data = text.encode()
    squeezed = packed(data, last)
    return squeezed, len(squeezed), len(data), zlib.crc32(data)


def _sheets(name: str, columns: list[str], folder: str, files: list[tuple[str, int, int, int, int]]) -> list[tuple[str, list]]:
    """(name, pieces) of the sheets that a table's parts fill, each with its headings."""
    groups, n = [[]], 1
    for f in files:
        if n + f[1] > SHEET_ROWS:
            groups.append([])
            n = 1
        groups[-1].append(f)
        n += f[1]
    head, foot = _piece(f'<?xml version="1.0" encoding="UTF-8"?><worksheet {_MAIN}><sheetData>{row(columns)}'), _piece("</sheetData></worksheet>", True)
    out = []
    for i, group in enumerate(groups):
        more = f" {i + 1}" if i else ""
        out.append((re.sub(r"[\[\]:*?/\\]", "_", name)[: NAME_CHARS - len(more)] + more, [head, *(((f"{folder}/{file}", packed_n), packed_n, size, crc) for file, _, packed_n, size, crc in group), foot]))
    return out


def write_workbook(sheets: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Tables as the sheets of one spreadsheet file; returns the rows of each table.

    A table's order is that of its partitions. One of more rows than a sheet can have goes
    on in further sheets ("Details 2"). A text that is too long for a cell is an error, and
    on any error neither a file nor a part is left. Tables without rows have headings only.
    """
    if not sheets:
        raise ValueError("a workbook has a sheet at least")
    spark: SparkSession = next(iter(sheets.values())).sparkSession
    spark.dataSource.register(SheetParts)
    folder, made, rows = f"{path}.parts-{uuid.uuid4().hex}", [], {}
    try:
        for i, (name, df) in enumerate(sheets.items()):
            own = f"{folder}/{i}"
            df.write.format("sheetparts").option("path", own).mode("append").save()
            fs = joined._fs(spark, own)
            stream = fs.open(joined._path(spark, f"{own}/manifest.json"))
            files = [tuple(f) for m in json.loads(bytes(stream.readAllBytes()).decode()) for f in m["files"]]
            stream.close()
            rows[name] = sum(f[1] for f in files)
            made += _sheets(name, df.columns, own, files)
        kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        numbers = range(1, len(made) + 1)
        texts = {
            "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{main}.worksheet+xml"/>' for i in numbers) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook {_MAIN} xmlns:r="{kind}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in zip(numbers, made, strict=True)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{kind}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>",
        }
        entries = [(n, [_piece('<?xml version="1.0" encoding="UTF-8"?>' + t, True)]) for n, t in texts.items()]
        entries += [(f"xl/worksheets/sheet{i}.xml", pieces) for i, (_, pieces) in zip(numbers, made, strict=True)]
        joined.join(spark, _archive(entries), path)
    finally:
        joined.delete(spark, folder)
    return rows


def read_workbook(path: str) -> dict[str, list[list[object]]]:
    """Sheets of a local file as lists of rows, headings first; for tests and small files."""
    import xml.etree.ElementTree as Tree
    import zipfile

    space = f"{{{_MAIN[7:-1]}}}"

    def value(c: Tree.Element) -> object:
        kind, v = c.get("t"), c.find(f"{space}v")
        if kind == "inlineStr":
            text = c.find(f"{space}is/{space}t").text or ""
            return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)
        if v is None:
            return None
        return v.text == "1" if kind == "b" else float(v.text) if re.search("[.eE]", v.text) else int(v.text)

    with zipfile.ZipFile(path) as z:
        if z.testzip() is not None:
            raise ValueError("damaged")
        names = [s.get("name") for s in Tree.fromstring(z.read("xl/workbook.xml")).iter(f"{space}sheet")]
        return {n: [[value(c) for c in r] for r in Tree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{space}row")] for i, n in enumerate(names, 1)}
