"""Repeated passages by sparse suffix arrays.

Of each text only the suffixes at minimiser positions are kept: of every WINDOW
neighbouring five-word groups the one of the least hash. Equal passages select equal
positions, and a passage of MIN_WORDS words has one among its first WINDOW words. So two
texts that share a passage share a kept suffix with at least MIN_WORDS - WINDOW + 1 equal
words after it. The suffixes are sorted by a hash of that prefix, over the whole corpus,
and compared with their neighbours: those that stand beside an equal prefix of another
text are matches. A match is extended to both sides at once: the places up to WINDOW - 1
words to its left that may start a passage are tried, each with the words on the right
that complete it, and these passages are sorted and compared with their neighbours in the
same way. Passages that overlap are merged. A word is covered if, and only if, it lies in a
passage of MIN_WORDS words that another text has too; equal texts are one text until the
end. Words are compared by hashes, passages by two independent ones with 96 bits together,
texts by one of 64 bits.

Sorting splits a hot passage over many tasks. A task reads its rows as a stream, batch by
batch, and knows the neighbours of all but those at the edges of a batch; these are settled
by two summaries a batch, not by the rows that share their key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, small_enough

MIN_WORDS = 50
GROUP, WINDOW = 5, 16

#: Bases of two independent hashes of runs of words.
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        out = np.cumprod(out, dtype=np.uint64)
    return out


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words, without regard to A-Z's case."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """A hash of each run of `size` words, by differences of prefix sums modulo 2^64."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    room = 1 << len(words).bit_length()  # few sizes, so that powers are kept
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(base, room)[: len(words)], dtype=np.uint64, out=sums[1:])
    x = (sums[size:] - sums[:n]) * _powers(pow(base, -1, 1 << 64), room)[:n]
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)  # the low bits alone are weak
    return x ^ x >> np.uint64(32)


def minimisers(words: np.ndarray, group: int = GROUP, window: int = WINDOW) -> np.ndarray:
    """Sorted positions of the least group hash, the leftmost one, in each window of groups."""
    hashes = window_hashes(words, group)
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(hashes, window).argmin(1)
    return np.unique(least + np.arange(len(least)))


def kept_suffixes(words: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Positions and prefix hashes of the suffixes that a text keeps."""
    prefix = least - WINDOW + 1
    at, hashes = minimisers(words), window_hashes(words, prefix)
    at = at[at < len(hashes)]
    return at, hashes[at]


def passages_near(words: np.ndarray, at: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts, with 32 bits of a second hash above them, and hashes of the passages of `least`
    words that reach left over a match by less than a window."""
    hashes = window_hashes(words, least)
    starts = np.unique((np.asarray(at, np.int64)[:, None] - np.arange(WINDOW)[None, :]).ravel())
    starts = starts[(starts >= 0) & (starts < len(hashes))]
    check = window_hashes(words, least, _OTHER)[starts] & np.uint64(0x7FFFFFFF)
    return starts | check.astype(np.int64) << 32, hashes[starts]


_ROWS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("pos", pa.int64())])


def _rows(df: DataFrame, make) -> DataFrame:
    """(key, id, pos) that make(text, ..) gives for each text; df: id, text, further columns.

    A task handles each text once. A row without key has the text's number of words as pos.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if values[0] in seen:
                    continue
                seen.add(values[0])
                words = word_hashes(values[1])
                at, keys = make(words, *values[2:])
                n = len(at)
                keys = pa.array(np.append(keys.view(np.int64), 0), mask=np.append(np.zeros(n, bool), True))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(n + 1, values[0], np.int64)), pa.array(np.append(at, len(words)).astype(np.int64))], schema=_ROWS)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.num_rows
            if size > 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return df.mapInArrow(grouped, "key long, id long, pos long")


_MARKED = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("pos", pa.int64()), ("state", pa.int32())])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows (key, id, pos) of a task that stand beside another id of their key, as
    state 1, each once.

    What only the rows after a batch or another task can tell is left open: the rows of a
    batch's last key, and of the task's first, that have one id so far, are state 2. Each
    batch also gives, as state 3, its first and its last key with their least id and their
    greatest (in pos); whether an open row's key has several ids follows from these alone.
    Nothing is held but the last row.
    """
    first = last = None  # the task's first key; the row before
    met = False  # whether its key has several ids up to there

    def out(keys: np.ndarray, ids: np.ndarray, pos: np.ndarray, state: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.array(pos), pa.array(np.full(len(keys), state, np.int32))], schema=_MARKED)

    for batch in batches:
        keys, ids, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]) | (pos[1:] != pos[:-1])
        if last and len(keys):
            new[0] = (keys[0], ids[0], pos[0]) != last
        keys, ids, pos = keys[new], ids[new], pos[new]
        if not len(keys):
            continue
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ends = np.append(starts[1:], len(keys))
        several = ids[starts] != ids[ends - 1]  # sorted, so a run has one id if its ends do
        if last and keys[0] == last[0]:
            several[0] |= met or ids[0] != last[1]
        rows = np.repeat(several, ends - starts)
        if rows.any():
            yield out(keys[rows], ids[rows], pos[rows], 1)
        first = keys[0] if last is None else first
        edges = [0, len(starts) - 1] if len(starts) > 1 else [0]
        for i in edges:
            if not several[i] and (i == len(starts) - 1 or keys[starts[i]] == first):
                yield out(keys[starts[i] : ends[i]], ids[starts[i] : ends[i]], pos[starts[i] : ends[i]], 2)
        yield out(keys[starts[edges]], ids[starts[edges]], ids[ends[edges] - 1], 3)
        last, met = (keys[-1], ids[-1], pos[-1]), bool(several[-1])


def repeated(rows: DataFrame) -> DataFrame:
    """The distinct rows (key long, id long, pos long) whose key another id has too. rows is read twice.

    Equal rows, as when several tasks bring in one text, are in one task and counted once there.
    """
    ordered = rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "pos")
    bounded_batches(rows.sparkSession)
    marked = materialise(ordered.mapInArrow(_mark, "key long, id long, pos long, state int"), "marked")
    edges = marked.where("state = 3").groupBy("key").agg(F.min("id").alias("a"), F.max("pos").alias("b"))
    whole = materialise(edges.where("a <> b").select("key"), "edges")
    met = marked.where("state = 2").join(F.broadcast(whole) if small_enough(whole) else whole, "key", "left_semi")
    return marked.where("state = 1").union(met).select("key", "id", "pos")


def passages(df: DataFrame, id_column: str = "doc_id", column: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """One row per document with a repeated passage of at least `least` words.

    id, n_words, n_repeated (words covered), spans (array of start, end in words, end
    exclusive, and first: the smallest id that has one of the span's passages). A text that
    several documents have is repeated as a whole if it is long enough. Null ids are
    ignored for `first`, which is null if no other is there; repeated rows that share id
    and text count as one document. Null and short texts give no row, nor does an empty
    table; other columns of df are ignored.
    """
    docs = df.select(F.col(id_column).alias("doc"), F.xxhash64(column).alias("id"), F.col(column).alias("text"))
    classes = materialise(docs.where("text is not null").select("doc", "id").distinct(), "documents")
    texts = materialise(classes.groupBy("id").agg(F.min("doc").alias("least"), F.count("*").alias("n")), "texts")

    kept = materialise(_rows(docs.where("text is not null").select("id", "text"), lambda words: kept_suffixes(words, least)), "suffixes")
    matches = repeated(kept.where("key is not null"))
    places = materialise(matches.groupBy("id").agg(F.collect_set("pos").alias("at")), "matches")
    side = F.broadcast(places) if small_enough(places) else places
    around = docs.join(side, "id").select("id", "text", "at")
    tried = materialise(_rows(around, lambda words, at: passages_near(words, at, least)), "passages")
    found = repeated(tried.where("key is not null")).select("key", F.shiftright("pos", 32).alias("check"), "id", F.col("pos").bitwiseAND(0xFFFFFFFF).cast("int").alias("pos"))
    found = materialise(found.distinct(), "repeated")

    firsts = found.select("key", "check", "id").distinct().join(texts.select("id", "least"), "id").groupBy("key", "check").agg(F.min("least").alias("first"), F.count("*").alias("n"))
    firsts = materialise(firsts.where("n > 1").drop("n"), "firsts")  # as a table of its own, the join below can split a hot key
    span = "array<struct<start:int,end:int,first:bigint>>"
    by = W.partitionBy("id").orderBy("pos")
    begins = F.when(F.col("pos") - F.lag("pos").over(by) <= least, 0).otherwise(1)
    islands = found.join(firsts, ["key", "check"]).withColumn("begins", begins).withColumn("island", F.sum("begins").over(by))
    islands = islands.groupBy("id", "island").agg(F.min("pos").alias("start"), (F.max("pos") + least).cast("int").alias("end"), F.min("first").alias("first"))
    spans = islands.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "first"))).alias("spans"))
    sizes = kept.where("key is null").groupBy("id").agg(F.max("pos").alias("n_words"))
    each = texts.join(sizes, "id").join(spans, "id", "left")
    copied = (F.col("n") > 1) & (F.col("n_words") >= least)
    firsts_of = F.array_min(F.transform("spans", lambda s: s["first"]))
    entire = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end"), F.least("least", firsts_of).alias("first"))).cast(span)
    each = each.withColumn("spans", F.when(copied, entire).otherwise(F.col("spans"))).where("spans is not null").select("id", "n_words", "spans")
    covered = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return classes.join(each, "id").select(F.col("doc").alias(id_column), "n_words", covered.alias("n_repeated"), "spans")


def report(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_repeated, spans as start:end of words, first_doc_id."""
    found = passages(df)
    line = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_repeated").cast("long").alias("n_repeated"), line.alias("spans"), F.array_min(F.transform("spans", lambda s: s["first"])).alias("first_doc_id"))


def oracle_sql() -> str:
    """The same rows in SQL, by comparing every passage of MIN_WORDS words."""
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
p AS (SELECT doc_id, n, s, md5(array_to_string(l[s + 1:s + {MIN_WORDS}], ' ')) AS key FROM (SELECT doc_id, l, len(l) AS n, unnest(range(0, len(l) - {MIN_WORDS - 1})) AS s FROM w WHERE len(l) >= {MIN_WORDS})),
k AS (SELECT key, min(doc_id) AS first FROM p GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT p.*, first, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= {MIN_WORDS} THEN 0 ELSE 1 END AS begins FROM p JOIN k USING (key)),
i AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM m),
r AS (SELECT doc_id, n, min(s) AS a, max(s) + {MIN_WORDS} AS b, min(first) AS first FROM i GROUP BY doc_id, n, island)
SELECT doc_id, n AS n_words, sum(b - a)::BIGINT AS n_repeated, string_agg(a || ':' || b, ',' ORDER BY a) AS spans, min(first) AS first_doc_id FROM r GROUP BY doc_id, n"""
