"""WARC archives written and read with Spark's own text files, verified by boundary chains.

Writing: a record is a string, and the record end of four bytes is the line separator,
so each part file is an archive. Repeated payloads become revisit records without a body.

Reading: files are split at the magic string, in ranges, by as many tasks as there are
blocks. A magic string may also stand inside a payload, so each piece is a candidate
only: it names the offset of its successor, by its header and length. Pointer jumping
then keeps what the start of the file reaches. It runs in two levels: a task jumps
through the candidates of its own block, in numpy, to the place where each chain leaves
the block; those places are joined and doubled over the blocks of a file; last, each
block walks again from the place where the file's chain enters it. Only narrow rows are
shuffled. Payloads that hold the magic string are put together in a second read, which
takes place only if there are any.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import bounded_batches, discard, materialise, run_dir, small_enough

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 100
#: There is no date column; the field is compulsory.
DATE = "1970-01-01T00:00:00Z"

#: No record is longer than this, so that offsets in a file stay far below 2^63.
FARTHEST = 1 << 60

#: Bytes of a file in which pieces and records look for each other.
STRETCH = 1 << 20

_M = len(MAGIC)


def write_archive(pages: DataFrame, path: str) -> None:
    """One record per row of pages (page_id long, url string, html string).

    A null html is an empty payload. Of equal payloads of LEAST_REVISIT bytes or more the
    one of the smallest page_id is a response, the others revisit it; where a null page_id
    is among them it revisits, and without any page_id all are responses. Rows that repeat
    the smallest page_id are responses too. Line ends in a url are percent-encoded.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), body.alias("body"), F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).alias("n"))
    again = rows.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1 and first is not null").select("digest", "first")
    again = materialise(again, "repeated")
    rows = rows.join(F.broadcast(again) if small_enough(again) else again, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("first"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), line("X-Payload-Length", F.col("n").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("body")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "none").text(path)
    discard(again)


_FIELDS = {
    "type": re.compile(rb"^WARC-Type: *([a-z]+)\r$", re.M | re.I),
    "id": re.compile(rb"^WARC-Record-ID: *<urn:page:(-?\d+)>\r$", re.M | re.I),
    "refers": re.compile(rb"^WARC-Refers-To: *<urn:page:(-?\d+)>\r$", re.M | re.I),
    "digest": re.compile(rb"^WARC-Payload-Digest: *sha256:([0-9a-f]+)\r$", re.M | re.I),
    "full": re.compile(rb"^X-Payload-Length: *(\d+)\r$", re.M | re.I),
    "length": re.compile(rb"^Content-Length: *(\d+)\r$", re.M | re.I),
}

_PIECES = T.StructType([T.StructField(n, t) for n, t in [
    ("file", T.StringType()), ("block", T.LongType()), ("seq", T.LongType()), ("at", T.LongType()), ("size", T.LongType()),
    ("next", T.LongType()), ("leaves", T.LongType()), ("page_id", T.LongType()), ("record_type", T.StringType()),
    ("refers_to", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("whole", T.BooleanType()), ("skip", T.LongType()), ("length", T.LongType()),
]])


def _scan(spark: SparkSession, path: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.option("lineSep", MAGIC).text(path).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("value"))


def _number(digits: bytes) -> int | None:
    """A number that a record of ours can hold; other digits, as payloads may have them, are none."""
    return int(digits) if len(digits) <= 20 and -(1 << 63) <= int(digits) < 1 << 63 else None


def _candidate(piece: bytes) -> dict:
    """What a piece says of itself, if it starts like a record.

    Payloads may imitate records: a header with a number that no record can hold, or a
    length that leads beyond any file, is no candidate.
    """
    head = piece.find(b"\r\n\r\n")
    if head < 0:
        return {}
    top = piece[: head + 2]
    got = {k: m[1] for k, p in _FIELDS.items() if (m := p.search(top))}
    if "length" not in got or "type" not in got:
        return {}
    numbers = {k: _number(got[k]) for k in ("length", "id", "refers", "full") if k in got}
    if None in numbers.values() or numbers["length"] > FARTHEST:
        return {}
    length, skip = numbers["length"], head + 4
    out = {"record_type": got["type"].decode().lower(), "page_id": numbers.get("id"), "refers_to": numbers.get("refers"), "skip": skip, "length": length, "whole": True}
    if out["record_type"] == "revisit":
        out |= {"payload_bytes": numbers.get("full", 0), "payload_digest": got.get("digest", b"").decode()}
    elif skip + length + 4 <= len(piece):
        payload = piece[skip : skip + length]
        out |= {"payload_bytes": length, "payload_digest": hashlib.sha256(payload).hexdigest()}
    else:
        out |= {"payload_bytes": length, "whole": False}
    return out


def _jump(at: np.ndarray, next_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates at sorted offsets: the index of each one's successor (itself if none
    of them is) and, by pointer jumping, of the last one on its chain."""
    own = np.arange(len(at))
    found = np.minimum(np.searchsorted(at, next_), max(0, len(at) - 1))
    step = np.where((at[found] == next_) & (found > own), found, own)
    last = step
    while (further := last[last]).tolist() != last.tolist():
        last = further
    return step, last


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates with offsets from the first line of their block."""
    held: list[dict] = []
    place = None

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            real = [i for i, r in enumerate(held) if r.get("next") is not None]
            if real:
                at, next_ = (np.array([held[i][k] for i in real]) for k in ("at", "next"))
                end = held[-1]["at"] + held[-1]["size"]
                _, last = _jump(at, next_)
                for i, j in zip(real, last.tolist(), strict=True):
                    held[i]["leaves"] = int(next_[j]) if next_[j] >= end else None
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in _PIECES.names} for r in held], _ARROW)
        held.clear()

    offset = seq = 0
    for batch in batches:
        for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place != (file, block):
                yield from flush()
                place, offset, seq = (file, block), 0, 0
            row = {"file": file, "block": block, "seq": seq, "at": offset - _M, "size": len(value) + _M}
            if block or seq:
                row |= _candidate(value)
                if "length" in row:
                    row["next"] = row["at"] + _M + row["skip"] + row["length"] + 4
            held.append(row)
            offset, seq = offset + len(value) + _M, seq + 1
    yield from flush()


_ARROW = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in _PIECES])


def _entries(pieces: DataFrame) -> DataFrame:
    """(file, block, enter): the offset, in its block, where the file's chain enters it."""
    ends = pieces.groupBy("file", "block").agg(F.sum("size").alias("size"))
    blocks = materialise(ends.withColumn("base", F.sum("size").over(W.partitionBy("file").orderBy("block")) - F.col("size")), "blocks")
    cands = pieces.where("next is not null").join(blocks, ["file", "block"])
    jumps = materialise(cands.where("leaves is not null").select("file", (F.col("at") + F.col("base")).alias("src"), (F.col("leaves") + F.col("base")).alias("dst")), "jumps")
    reached = materialise(pieces.select("file").distinct().select("file", F.lit(0).cast("long").alias("src")), "reached")
    n = reached.count()
    while True:  # after k rounds: what 2^k leaps from block to block reach
        more = materialise(reached.union(reached.join(jumps, ["file", "src"]).select("file", F.col("dst").alias("src"))).distinct(), "reached")
        discard(reached)
        reached, before, n = more, n, more.count()
        if n == before:
            break
        twice = materialise(jumps.join(jumps.select("file", F.col("src").alias("dst"), F.col("dst").alias("far")), ["file", "dst"]).select("file", "src", F.col("far").alias("dst")), "jumps")
        discard(jumps)
        jumps = twice
    places = cands.select("file", "block", "at", (F.col("at") + F.col("base")).alias("src"))
    return materialise(places.join(reached, ["file", "src"]).groupBy("file", "block").agg(F.min("at").alias("enter")), "entries")


def _walk(group: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block that the place of entry reaches, and the pieces they hold."""
    group = group.sort_values("seq")
    real = group[group["next"].notna()]
    at, next_ = real["at"].to_numpy(np.int64), real["next"].to_numpy(np.int64)
    step, _ = _jump(at, next_)
    i, kept = int(np.searchsorted(at, real["enter"].iloc[0])), []
    while True:
        kept.append(i)
        if step[i] == i:
            break
        i = int(step[i])
    return real.iloc[kept][_PIECES.names]


def _assembled(spark: SparkSession, path: str, split: DataFrame, pieces: DataFrame) -> DataFrame:
    """(file, block, seq, digest) of records whose payload lies in more than one piece.

    A record's pieces are those from its own up to where its length ends; they are
    found by position, in stretches of the file that both sides name, and brought
    together by record, which is one row's worth. Records do not overlap, so a piece has
    one owner at most, and no task needs a whole file.
    """
    sizes = pieces.groupBy("file", "block").agg(F.sum("size").alias("total"))
    blocks = sizes.withColumn("base", F.sum("total").over(W.partitionBy("file").orderBy("block")) - F.col("total")).drop("total")
    placed = pieces.join(blocks, ["file", "block"]).select("file", "block", "seq", (F.col("at") + F.col("base")).alias("pos"))
    marks = split.join(blocks, ["file", "block"]).select("file", (F.col("at") + F.col("base")).alias("pos"), F.struct((F.col("next") + F.col("base")).alias("stop"), F.col("block").alias("b"), F.col("seq").alias("s"), "skip", "length").alias("rec"))
    stretch = lambda at: F.floor(at / STRETCH)
    spread = marks.select("file", F.col("pos").alias("from"), "rec", F.explode(F.sequence(stretch(F.col("pos")), stretch(F.col("rec.stop") - 1))).alias("stretch"))
    owner = placed.withColumn("stretch", stretch(F.col("pos"))).join(materialise(spread, "spread"), ["file", "stretch"]).where("pos >= from and pos < rec.stop")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seq = None, 0
        for batch in batches:
            out = []
            for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place, seq = (file, block), (seq + 1 if place == (file, block) else 0)
                out.append(seq)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=["file", "block", "value", "seq"])

    raw = _scan(spark, path).mapInArrow(numbered, "file string, block long, value binary, seq long")

    def whole(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        body = MAGIC.encode().join(parts.sort_values("pos")["value"])
        skip, length = int(parts["skip"].iloc[0]), int(parts["length"].iloc[0])
        return pd.DataFrame([[*key, hashlib.sha256(body[skip : skip + length]).hexdigest()]], columns=["file", "block", "seq", "digest"])

    joined = raw.join(owner, ["file", "block", "seq"]).select("file", F.col("rec.b").alias("block"), F.col("rec.s").alias("seq"), "pos", "value", "rec.skip", "rec.length")
    return joined.groupBy("file", "block", "seq").applyInPandas(whole, "file string, block long, seq long, digest string")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record that the start of its file reaches.

    page_id, payload_bytes, payload_digest (of the full payload, computed from the bytes;
    a revisit has those of the response that it refers to, and what its header says only
    where that response is missing), record_type, refers_to. What follows a broken link of
    the chain is not returned; an empty folder gives no rows, records that repeat stay.
    """
    pieces = materialise(_scan(spark, path).mapInArrow(_pieces, _PIECES), "pieces")
    entries = _entries(pieces)
    entered = pieces.where("next is not null").join(entries, ["file", "block"])
    records = materialise(entered.groupBy("file", "block").applyInPandas(_walk, _PIECES), "records")
    split = records.where("not whole")
    if not split.isEmpty():
        whole = materialise(_assembled(spark, path, split, pieces), "assembled")
        records = records.join(whole, ["file", "block", "seq"], "left").withColumn("payload_digest", F.coalesce("digest", "payload_digest"))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    records = materialise(records.select(*out), "read")
    full = records.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("of"), F.col("payload_digest").alias("own_digest"), F.col("payload_bytes").alias("own_bytes")).distinct()
    again = records.where("record_type = 'revisit'").join(full, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("own_digest")), "left")
    again = again.withColumn("payload_bytes", F.coalesce("own_bytes", "payload_bytes")).withColumn("payload_digest", F.coalesce("own_digest", "payload_digest"))
    return records.where("record_type <> 'revisit'").select(*out).unionAll(again.select(*out))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back.

    Returns one row per row of pages, as read_archive() and write_archive() state: null
    html is empty, rows that repeat stay, an empty table gives no rows, other columns of
    pages are ignored.
    """
    spark = pages.sparkSession
    path = f"{run_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return read_archive(spark, path)


def oracle_sql() -> str:
    """What a round trip must return, from the table alone."""
    return f"""WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)"""
