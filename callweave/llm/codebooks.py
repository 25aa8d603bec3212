"""Product codes of vectors: each vector is sixteen parts, each part the index of a codebook entry.

Vectors become integers, so that distances and sums are exact and do not depend on how
the rows are split. Tasks hold them as columnar blocks: one array per component. Squared
distances to the entries of a part accumulate component by component; np.add.at adds a
block's parts to the sums and counts of their nearest entries, and these tensors, whose
size is fixed by the codebooks alone, merge through the tree of RDD.treeAggregate. The
driver sees a codebook and its sums, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from .common import bounded_batches, materialise, small_enough

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256

#: Vectors that are compared at once, so that their distances stay in a processor's cache.
_AT_ONCE = 2048
#: Number types of blocks: the narrowest that holds all components; the last for those that
#: no machine integer holds, since a double's whole part is a double too.
_KINDS = ["i2", "i4", "i8", "f8"]


def _kind(most: float) -> str:
    return next((k for k in _KINDS[:3] if most < float(1 << (8 * int(k[1]) - 1))), "f8")


def _whole(data: np.ndarray) -> np.ndarray:
    """Integers of a block; those of any size are Python's."""
    if data.dtype.kind != "f":
        return data
    return np.array([int(x) for x in data.ravel()], object).reshape(data.shape)


def _fitting(points: np.ndarray, entries: np.ndarray) -> type:
    """The type in which squared distances between points and entries are exact."""
    if points.dtype == object or entries.dtype == object:
        return object
    most = max((int(np.abs(x.astype(np.int64)).max()) for x in (points, entries) if x.size), default=0)
    most = 4 * most * most * max(1, len(points))
    return np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the first of equally near ones, and the squared distance.

    points: component x vector, entries: component x entry, both integers.
    """
    kind = _fitting(points, entries)
    points, entries = points.astype(kind), entries.astype(kind)
    at, far = [], []
    for i in range(0, points.shape[1], _AT_ONCE):
        block = points[:, i : i + _AT_ONCE]
        total = np.zeros((block.shape[1], entries.shape[1]), kind)
        for x, c in zip(block, entries, strict=True):
            gap = x[:, None] - c[None, :]
            total += gap * gap
        found = total.argmin(1)
        at.append(found)
        far.append(total[np.arange(len(found)), found])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    far = np.concatenate(far)
    return np.concatenate(at), far if kind is object else far.astype(np.int64)


def _assigned(data: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its points, nearest entries, distances) of a block; books: part x component x entry."""
    points = _whole(data).reshape(PARTS, -1, data.shape[1])
    for p in range(PARTS):
        yield (p, points[p], *nearest(points[p], books[p]))


def _decoded(kind: str, dim: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<{kind}").reshape(dim, -1)


def add_block(total: tuple[np.ndarray, np.ndarray], block: tuple[str, int, bytes], books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """total (sums by part, entry and component, and counts) with a block's parts added."""
    sums, counts = total
    for p, points, at, _ in _assigned(_decoded(*block), books):
        if points.dtype == object and sums.dtype != object:
            sums = sums.astype(object)
        np.add.at(sums[p], at, points.T.astype(sums.dtype))
        np.add.at(counts[p], at, 1)
    return sums, counts


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """books with each entry that has parts at their mean, rounded down."""
    means = sums // np.maximum(counts, 1)[:, :, None]
    means = means.transpose(0, 2, 1)
    return np.where(counts[:, None, :] > 0, means, books)


def _blocks(df: DataFrame, id_column: str, column: str, label_column: str) -> DataFrame:
    """Columnar blocks (dim, kind, data, ids, labels) of the finite vectors.

    Vectors whose length is no multiple of PARTS, or nothing, have blocks without data.
    """
    out_schema = df.select(F.array(F.col(id_column)).alias("ids"), F.array(F.col(label_column)).alias("labels")).schema
    kinds = [to_arrow_type(out_schema[c].dataType.elementType) for c in ("ids", "labels")]
    layout = pa.schema([("dim", pa.int32()), ("kind", pa.string()), ("data", pa.binary()), ("ids", pa.list_(kinds[0])), ("labels", pa.list_(kinds[1]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths >= 0]):
                rows = np.flatnonzero(lengths == dim)
                flat = vectors.take(pa.array(rows)).flatten()
                matrix = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
                fine = np.isfinite(matrix).all(1) & np.isfinite(matrix * SCALE).all(1)
                whole = np.floor(matrix[fine] * SCALE)
                if not len(whole):
                    continue
                coded = dim > 0 and dim % PARTS == 0
                kind = _kind(np.abs(whole).max() if whole.size else 0)
                data = np.ascontiguousarray(whole.T).astype(f"<{kind}").tobytes() if coded else None
                keys = [pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), batch.column(i).take(pa.array(rows[fine]))).cast(pa.list_(kinds[i])) for i in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([kind]), pa.array([data], pa.binary()), *keys], schema=layout)

    bounded_batches(df.sparkSession)
    fields = ", ".join(f"{c} {out_schema[c].dataType.simpleString()}" for c in ("ids", "labels"))
    return df.select(id_column, label_column, column).mapInArrow(run, f"dim int, kind string, data binary, {fields}")


def _heads(blocks: DataFrame) -> DataFrame:
    """(id, dim, vector) of each block's ENTRIES smallest ids, nulls last."""
    kind = blocks.schema["ids"].dataType.elementType
    layout = pa.schema([("id", to_arrow_type(kind)), ("dim", pa.int32()), ("vector", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, number, data, ids in zip(*(batch.column(c) for c in ("dim", "kind", "data", "ids")), strict=True):
                keys, points = ids.values, _decoded(number.as_py(), dim.as_py(), data.as_py()).astype(np.float64)
                order = pc.sort_indices(pa.table({"k": keys, **{f"c{i}": x for i, x in enumerate(points)}}), sort_keys=[("k", "ascending"), *((f"c{i}", "ascending") for i in range(len(points)))], null_placement="at_end")[:ENTRIES]
                flat = pa.array(np.ascontiguousarray(points[:, order.to_numpy()].T).ravel())
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * len(points), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([keys.take(order).cast(layout.field("id").type), pa.array(np.full(len(order), len(points), np.int32)), vectors], schema=layout)

    return blocks.where("data is not null").mapInArrow(run, f"id {kind.simpleString()}, dim int, vector array<double>")


def first_books(blocks: DataFrame) -> np.ndarray:
    """part x component x entry: the parts of the ENTRIES smallest ids' vectors, in this order.

    The length of vectors is that of the smallest id's. Equal ids follow each other by
    their vectors. Without a vector there is no component.
    """
    heads = materialise(_heads(blocks), "heads")
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    least = heads.orderBy(*order).limit(1).collect()
    if not least:
        return np.zeros((PARTS, 0, 0), np.int64)
    rows = heads.where(F.col("dim") == least[0]["dim"]).orderBy(*order).limit(ENTRIES).collect()
    points = np.array([r["vector"] for r in rows], np.float64)
    points = points.astype(np.int64) if np.abs(points).max() < 1 << 62 else _whole(points)
    return points.T.reshape(PARTS, -1, len(rows))


def train(blocks: DataFrame, rounds: int = ROUNDS, depth: int = 3) -> np.ndarray:
    """The codebooks after `rounds` rounds over all blocks, merged by a tree of `depth` levels."""
    books = first_books(blocks)
    if not books.size:
        return books
    dim = PARTS * books.shape[1]
    rdd = blocks.where((F.col("dim") == dim) & F.col("data").isNotNull()).select("kind", "dim", "data").rdd.map(tuple)
    for _ in range(rounds):
        sent = blocks.sparkSession.sparkContext.broadcast(books)
        zero = np.zeros((PARTS, books.shape[2], books.shape[1]), np.int64), np.zeros((PARTS, books.shape[2]), np.int64)
        sums, counts = rdd.treeAggregate(zero, lambda total, block, sent=sent: add_block(total, block, sent.value), merged, depth)
        books = moved(books, sums, counts)
        sent.unpersist()
    return books


def encode(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code and error of every vector of the blocks."""
    types = [blocks.schema[c].dataType.elementType for c in ("ids", "labels")]
    layout = pa.schema([("id", to_arrow_type(types[0])), ("label", to_arrow_type(types[1])), ("code", pa.string()), ("error", pa.int64())])
    dim, digits = PARTS * books.shape[1], np.array([f"{i:02x}" for i in range(max(1, books.shape[2]))], "U2")
    sent = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, number, data, ids, labels in zip(*(batch.column(c) for c in ("dim", "kind", "data", "ids", "labels")), strict=True):
                n = len(ids.values)
                codes = errors = [None] * n
                if data.is_valid and own.as_py() == dim:
                    found = [(at, far) for _, _, at, far in _assigned(_decoded(number.as_py(), dim, data.as_py()), sent.value)]
                    text = digits[found[0][0]]
                    for at, _ in found[1:]:
                        text = np.char.add(text, digits[at])
                    codes, errors = text.tolist(), [None if e >> 63 else e for e in sum(far.astype(object) for _, far in found)]
                yield pa.RecordBatch.from_arrays([ids.values.cast(layout.field("id").type), labels.values.cast(layout.field("label").type), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], schema=layout)

    return blocks.mapInArrow(run, f"id {types[0].simpleString()}, label {types[1].simpleString()}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.transpose(0, 2, 1).ravel()).encode()).hexdigest()


def compress(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", label_column: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of every finite vector.

    Vectors that are null or hold null, NaN or infinite components (or ones that overflow
    when scaled) are dropped. The others become floor(256 x). A vector of another length
    than the smallest id's, or of a length that sixteen does not divide, stays, with null
    as code and error. Repeated rows and repeated ids are vectors of their own; a null id
    comes after all others. With fewer than 64 vectors a codebook has as many entries. An
    error or a label's sum that no long holds is null, as is the sum of a label without
    errors; null labels count together. An empty table gives none; other columns are ignored.
    """
    blocks = materialise(_blocks(df, id_column, column, label_column), "blocks")
    books = train(blocks, rounds)
    coded = materialise(encode(blocks, books), "codes")
    sums = materialise(coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum")), "labels")
    sums = sums.select("_label", F.col("_sum").try_cast(LongType()).alias("label_error"))
    joined = coded.join(F.broadcast(sums) if small_enough(sums) else sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The same rows in SQL: each part beside each entry of its codebook, round by round."""

    def near(i: int) -> str:
        return f"""n{i} AS (SELECT vec_id, label, p.p, any_value(p.x) AS x, min(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))::BIGINT * {ENTRIES} + c.e) AS best FROM parts p JOIN c{i} c USING (p) GROUP BY ALL)"""

    def move(i: int) -> str:
        return f"""s{i} AS (SELECT p, best % {ENTRIES} AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM n{i}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS i) GROUP BY ALL),
m{i} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{i} GROUP BY ALL),
c{i + 1} AS (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (p, e))"""

    rounds = ",\n".join(f"{near(i)},\n{move(i)}" for i in range(ROUNDS))
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS x FROM k, (SELECT unnest(range({PARTS})) AS p)),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts QUALIFY e < {ENTRIES}),
{rounds},
{near(ROUNDS)},
o AS (SELECT vec_id, label, string_agg(format('{{:02x}}', best % {ENTRIES}), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM n{ROUNDS} GROUP BY ALL),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM o GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256 FROM o JOIN l ON o.label IS NOT DISTINCT FROM l.label"""
