"""One file out of many parts: tasks write the parts, the file system joins them in order.

A part's bytes go from one stream to the other within the JVM's file system, never into
this process, and rows are never parsed again. The file appears under its name only when
it is whole.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import SparkSession

Piece = bytes | tuple[str, int]


def _path(spark: SparkSession, path: str) -> Any:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str) -> Any:
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def parts_of(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """The files that a write has left in a folder, in the order of its partitions, with their bytes."""
    fs = _fs(spark, folder)
    found = ((s.getPath().toString(), s.getLen(), s.getPath().getName()) for s in fs.listStatus(_path(spark, folder)))
    return [(p, n) for p, n, name in sorted(found, key=lambda f: f[2]) if name.startswith("part-") and n > 0]


def join(spark: SparkSession, pieces: list[Piece], target: str) -> list[int]:
    """Write pieces (bytes, or a file and how many of its first bytes) as one file; returns where each begins.

    An existing file is replaced, at the end and in one step; on an error nothing is left.
    """
    jvm, fs, conf = spark._jvm, _fs(spark, target), spark._jsc.hadoopConfiguration()
    final = _path(spark, target)
    fresh = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{final.getName()}.{uuid.uuid4().hex}")
    offsets, at = [], 0
    try:
        out = fs.create(fresh, True)
        try:
            for piece in pieces:
                offsets.append(at)
                if isinstance(piece, bytes):
                    out.write(bytearray(piece))
                    at += len(piece)
                    continue
                path, n = piece
                stream = _fs(spark, path).open(_path(spark, path))
                try:
                    jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, int(n))
                finally:
                    stream.close()
                at += n
        finally:
            out.close()
        if fs.getFileStatus(fresh).getLen() != at:
            raise OSError(f"{target}: a part is shorter than was said")
        overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(final).toUri(), conf).rename(fs.makeQualified(fresh), fs.makeQualified(final), overwrite)
    finally:
        if fs.exists(fresh):
            fs.delete(fresh, False)
    return offsets


def delete(spark: SparkSession, folder: str) -> None:
    _fs(spark, folder).delete(_path(spark, folder), True)
