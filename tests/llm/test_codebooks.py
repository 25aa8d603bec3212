import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from callweave.llm import codebooks


def brute(rows, rounds=2):
    """Straight loops over Python integers; rows (vec_id, vector, label) of one length."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    d = len(kept[0][1]) // 16
    part = lambda v, p: v[p * d : p * d + d]
    books = [[part(v, p) for _, v, _ in kept[:64]] for p in range(16)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    best = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(16):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(best(part(v, p), books[p])[1], []).append(part(v, p))
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True)] if e in groups else c for e, c in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        found = [best(part(v, p), books[p]) for p in range(16)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(f for f, _ in found)))
    total = {}
    for _, label, _, e in out:
        total[label] = total.get(label, 0) + e
    long = lambda x: x if x < 1 << 63 else None
    return [(i, code, long(e), long(total[label]), sha) for i, label, code, e in out]


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)
    return df.withColumn("id", F.lit("clash")).withColumn("data", F.lit(0)).withColumn("code", F.lit(1)).withColumn("dim", F.lit(2))


def vectors(n, dim, scale=1.0, seed=1):
    r = random.Random(seed)
    f = lambda x: struct_float(x)
    return [[f(r.gauss(0, 1) * scale) for _ in range(dim)] for _ in range(n)]


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def both(spark, rows, parts=3):
    got = sorted(map(tuple, codebooks.compress(frame(spark, rows, parts)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    return got


@pytest.mark.parametrize("dim, scale", [(16, 1.0), (64, 0.1), (32, 3000.0), (16, 1e7), (16, 1e30)])
def test_equals_loops(spark, dim, scale):
    rows = [(7 * i % 301, v, i % 4 if i % 5 else None) for i, v in enumerate(vectors(150, dim, scale))]
    assert len(both(spark, rows)) == 150


def test_dropped_and_repeated(spark):
    v = vectors(6, 16)
    rows = [(3, v[0], 1), (3, v[1], 1), (3, v[0], 1), (None, v[2], None), (None, v[2], None), (1, None, 1), (2, v[3][:5] + [None] + v[3][6:], 1), (4, v[4][:15] + [math.nan], 2), (5, v[4][:15] + [-math.inf], 2), (-1, v[5], 9)]
    assert len(both(spark, rows)) == 6


def test_ties_take_the_lower_entry(spark):
    rows = [(i, [float(i % 2)] * 16, 0) for i in range(200)]
    got = both(spark, rows)
    assert {r[1] for r in got} == {"00" * 16, "01" * 16}


def test_other_lengths_stay_without_code(spark):
    rows = [(i, v, 1) for i, v in enumerate(vectors(5, 32))] + [(90, [1.0] * 16, 1), (91, [1.0] * 17, 2), (92, [], None)]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in codebooks.compress(frame(spark, rows)).collect()}
    want = {r[0]: (r[1], r[2], r[3]) for r in brute(rows[:5])}
    assert got == {**want, 90: (None, None, want[0][2]), 91: (None, None, None), 92: (None, None, None)}


def test_empty(spark):
    assert codebooks.compress(frame(spark, [])).count() == 0
    assert codebooks.compress(frame(spark, [(1, None, 1)])).count() == 0


def test_splits_do_not_matter(spark):
    rows = [(i, v, 1) for i, v in enumerate(vectors(300, 16, seed=4))]
    assert both(spark, rows, 1) == both(spark, rows, 17)


def test_unused_entries_stay():
    import numpy as np

    books = np.arange(16 * 2 * 3).reshape(16, 2, 3)
    sums, counts = np.full((16, 3, 2), -7), np.zeros((16, 3), int)
    counts[:, 1] = 2
    out = codebooks.moved(books, sums, counts)
    assert (out[:, :, 1] == -4).all() and (out[:, :, ::2] == books[:, :, ::2]).all()


def test_equals_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    got = codebooks.compress(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({codebooks.oracle_sql()})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
