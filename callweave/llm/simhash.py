"""SimHash fingerprints and their near-duplicate groups by pigeonhole blocks.

A fingerprint has four blocks of 16 bits. Two that differ in at most two bits agree
on at least two whole blocks, so they meet under one of six keys of two blocks.
Equal fingerprints are one node from the start. A key with few fingerprints compares
its pairs; a key with many does not: there each fingerprint is sent to itself and to
its neighbours at one flipped bit outside the key, and those that meet at one place
are within two bits of each other and are linked as a star. Both give the same
groups, and the second grows with the fingerprints, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, without
from .graph import connected_components

#: Distinct fingerprints under a key from which stars replace pairs.
PAIRS_UP_TO = 24
SHINGLE_WORDS = 3
BITS = 2

_SEED = 42
_BLOCK = 16
_KEYS = [(i, j) for i in range(4) for j in range(i)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(pair: tuple[int, int]) -> int:
    return sum(((1 << _BLOCK) - 1) << (_BLOCK * i) for i in pair)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The signed 64-bit SimHash of a text; 0 without words."""
    parts = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII blanks alone
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    n = max(1, len(parts) - words + 1)
    size = min(words, len(parts)) - 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[starts[i] : ends[i + size]], _SEED) for i in range(n)), ">u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(df: DataFrame, column: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """df's other columns and fp long, the fingerprint of a text column.

    A null text counts as empty. A column of df that is called fp is replaced.
    """
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in (column, "fp")]
    df = df.select(*[df[f"`{c}`"] for c in [*kept, column]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(t, words) for t in batch.column(len(kept)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], made], names=[*kept, "fp"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[: len(kept)])
    return df.mapInArrow(run, f"{ddl}, fp long" if ddl else "fp long")


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints within two bits of each other.

    nodes: fp long, each once. Every pair within two bits is linked directly or, under
    a key with many fingerprints, through a star whose links are within two bits too.
    """
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(_mask(k)))) for k in _KEYS])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(keyed.join(materialise(sizes, "sizes"), ["t", "key"]), "blocks")  # from a table, the join can split a hot key
    few = shared.where(F.col("n") <= PAIRS_UP_TO).select("t", "key", "fp")
    other = few.select("t", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= BITS
    pairs = few.join(other, ["t", "key"]).where((F.col("fp") > F.col("b")) & near).select(F.col("fp").alias("a"), "b").distinct()

    spots = shared.where(F.col("n") > PAIRS_UP_TO).select("t", "fp", F.explode(_spots(F.col("t"), F.col("fp"))).alias("spot")).select("fp", "spot").distinct()
    hubs = spots.groupBy("spot").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = spots.join(hubs, "spot").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.union(stars)


def _spots(t: Column, fp: Column) -> Column:
    """fp and fp with each one bit flipped that key t does not hold."""
    out = F.lit(None)
    for i, pair in enumerate(_KEYS):
        free = [b for b in range(64) if not _mask(pair) >> b & 1]
        flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)).cast("long") for b in free])
        out = F.when(t == i, flips).otherwise(out)
    return F.transform(out, lambda flip: flip.bitwiseXOR(fp))


def _grouped(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, text_hash, fp, component_id and the winner of its group, for each row of df."""
    rows = df.select(F.col(id_column), F.xxhash64(column).alias("text_hash"), F.col(column).alias("_text"))
    rows = materialise(fingerprints(rows, "_text"), "fingerprints")
    rank = F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id"), F.col("text_hash").alias("hash"))
    nodes = materialise(rows.groupBy("fp").agg(F.min(rank).alias("winner")), "nodes")
    roots = connected_components(links(nodes.select("fp")))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "winner", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("winner").alias("winner"))
    found = named.select("fp", "root").join(least, "root").select("fp", "winner")
    return rows.join(found, "fp").withColumn("component_id", F.col("winner.id"))


def groups(df: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """id, fp long and component_id of each row of df: the smallest id in reach.

    Rows of equal fingerprints are in one group, whatever their texts; texts without
    words have fingerprint zero and are grouped like any other. Null ids are ignored
    where another id is in reach, else component_id is null. Repeated rows stay.
    """
    return _grouped(df, id_column, column).select(id_column, "fp", "component_id")


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(df: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """The rows of df without those that another document of their group stands for.

    The document of the smallest id stays; ids that are null come after all others, and
    among equal ids the text of the smallest hash stays. Rows that repeat both id and
    text are one document and stay together. What goes is the smaller side by far, so it
    is what the texts are joined with: broadcast where its size allows, else by a shuffle.
    """
    found = _grouped(df, id_column, column)
    stays = F.col(id_column).eqNullSafe(F.col("winner.id")) & (F.col("text_hash") == F.col("winner.hash"))
    return without(df, materialise(found.where(~stays).select(id_column, "text_hash").distinct(), "copies"), id_column, column)
