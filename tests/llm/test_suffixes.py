import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from callweave.llm import suffixes


def brute(docs, least=50):
    """Covered spans of words by comparing every passage."""
    words = [(i, (t or "").encode().lower().split()) for i, t in docs]
    owners = defaultdict(set)
    for k, (_, w) in enumerate(words):
        for p in range(len(w) - least + 1):
            owners[tuple(w[p : p + least])].add(k)
    out = []
    for i, w in words:
        spans = []
        for p in range(len(w) - least + 1):
            if len(owners[tuple(w[p : p + least])]) > 1:
                if spans and spans[-1][1] >= p:
                    spans[-1][1] = p + least
                else:
                    spans.append([p, p + least])
        if spans:
            out.append((i, len(w), sum(b - a for a, b in spans), ",".join(f"{a}:{b}" for a, b in spans)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_repeated, r.spans) for r in suffixes.report(df).collect()), key=str)


def corpus():
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    shared = [fresh(n) for n in (49, 50, 51, 70, 200)]
    docs = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += fresh(rng.randint(0, 60))
            if rng.random() < 0.5:
                p = rng.choice(shared)
                cut = rng.randint(0, 5) if rng.random() < 0.3 else 0
                parts += p[cut:]
        docs.append(" ".join(parts))
    docs += ["same " * 120, "Same " * 90, docs[0], docs[0], docs[1].upper(), " ".join(shared[3][:35] + shared[4][:35]), "", None, "short text", " ".join(fresh(30_000) + shared[2])]
    return list(enumerate(docs))


def test_equals_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, spans string, id int").repartition(3)
    assert got(df) == brute(docs)


def test_the_first_document_is_named(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(7, "a " + passage), (3, passage + " b"), (5, "alone here"), (9, "x y z " * 5 + passage)]
    rows = suffixes.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_doc_id) for r in rows} == {(7, 3), (3, 3), (9, 3)}


def test_odd_tables(spark):
    text = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, None)], "doc_id long, text string")
    rows = suffixes.report(df).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "None"] and {r.first_doc_id for r in rows} == {1}
    assert suffixes.report(df.limit(0)).count() == 0
    once = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert suffixes.report(once).count() == 0  # one document, listed twice


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_edges_of_sorted_tasks(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(int(partitions))
        rows = [(rng.randrange(60), rng.randrange(4), rng.randrange(50)) for _ in range(150)] + [(99, i, 0) for i in range(300)] + [(98, 5, i) for i in range(200)]
        owners = defaultdict(set)
        for k, i, _ in rows:
            owners[k].add(i)
        want = sorted({r for r in rows if len(owners[r[0]]) > 1})  # equal rows are one
        df = spark.createDataFrame(rows, "key long, id long, pos int")
        assert sorted(map(tuple, suffixes.repeated(df).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_equal_passages_keep_equal_suffixes():
    rng = np.random.default_rng(3)
    for _ in range(50):
        passage = rng.integers(0, 2**63, 50).astype(np.uint64)
        kept = []
        for _ in range(2):
            left, right = (rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
            at, keys = suffixes.kept_suffixes(np.concatenate((left, passage, right)))
            inside = (at >= len(left)) & (at < len(left) + suffixes.WINDOW)
            kept.append({(int(a) - len(left), int(k)) for a, k in zip(at[inside], keys[inside], strict=True)})
        assert kept[0] & kept[1]


def test_window_hashes_depend_on_words_alone():
    a = np.arange(100, 400, dtype=np.uint64)
    shifted = np.concatenate((np.arange(9, dtype=np.uint64), a))
    assert (suffixes.window_hashes(a, 35) == suffixes.window_hashes(shifted, 35)[9:]).all()
    assert len(np.unique(suffixes.window_hashes(a, 35))) == 266
    assert len(suffixes.window_hashes(a, 301)) == 0


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.execute(f"SELECT doc_id, n_words, n_repeated, spans, first_doc_id FROM ({suffixes.oracle_sql()})").fetchall()
    rows = suffixes.report(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(tuple(r) for r in rows) == sorted(want) and want


def settle(tasks):
    """What repeated() makes of the marks of tasks: their rows, and how many were left open."""
    marks = [tuple(r.values()) for batches in tasks for b in suffixes._mark(iter(batches)) for r in b.to_pylist()]
    ends = defaultdict(list)
    for key, least, most, state in marks:
        if state == 3:
            ends[key] += [least, most]
    whole = {k for k, ids in ends.items() if min(ids) < max(ids)}
    return sorted(m[:3] for m in marks if m[3] == 1 or m[3] == 2 and m[0] in whole), [m for m in marks if m[3] == 2]


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["key", "id", "pos"])


def test_runs_are_marked_batch_by_batch():
    """Every cut into tasks and batches gives each row of a shared key once; a task has all rows of a key and id."""
    rng = random.Random(1)
    for _ in range(2500):
        n = rng.randint(0, 16)
        rows = sorted((rng.randrange(4), rng.randrange(3), rng.randrange(5)) for _ in range(n))
        tasks, at = [[]], 0
        while at < n or rng.random() < 0.1:
            k = rng.randint(0, 5)
            if at and at < n and rows[at][:2] != rows[at - 1][:2] and rng.random() < 0.5:
                tasks.append([])
            cut = next((i for i in range(at + 1, min(at + k, n)) if rows[i][:2] != rows[i - 1][:2] and rng.random() < 0.3), at + k)
            tasks[-1].append(batch(rows[at:cut]))
            at = cut
        ids = defaultdict(set)
        for key, i, _ in rows:
            ids[key].add(i)
        assert settle(tasks)[0] == sorted({r for r in rows if len(ids[r[0]]) > 1})


def test_a_hot_key_leaves_few_rows_open():
    """One key of many ids over eight tasks, and many copies of one row."""
    rows = [(7, i, 3) for i in range(40_000)]
    tasks = [[batch(rows[a : a + 1000]) for a in range(t, t + 5000, 1000)] for t in range(0, 40_000, 5000)]
    found, still = settle(tasks)
    assert found == rows and len(still) == 0
    copies = [(1, 1, 1)] * 90_000 + [(1, 2, 5)] + [(2, 1, 1)] * 90_000
    found, still = settle([[batch(copies[a : a + 7000]) for a in range(0, len(copies), 7000)]])
    assert found == [(1, 1, 1), (1, 2, 5)] and len(still) <= 2


def test_a_text_that_all_tasks_bring_in(spark):
    """Copies of one text in twenty tasks, and a text whose suffixes fill several, beside brute force."""
    rng = random.Random(6)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(70))
    copied = f"start {passage} " + " ".join(f"c{i}" for i in range(90))
    rows = [(i, copied) for i in range(400)] + [(1000, f"other words {passage} end"), (1001, "same word " * 4000), (1002, " ".join(f"x{i}" for i in range(60))), (1003, "same word " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    c = duckdb.connect()
    c.register("documents", df.toPandas())
    want = c.execute(f"SELECT doc_id, n_words, n_repeated, spans, first_doc_id FROM ({suffixes.oracle_sql()})").fetchall()
    assert sorted(map(tuple, suffixes.report(df).collect())) == sorted(want) and len(want) == 403


def test_repeated_rows_of_one_id_over_tasks(spark):
    """Keys whose rows fill tasks: only those of several ids come out, each row once."""
    rows = spark.range(60_000).selectExpr("id % 3 AS key", "IF(id % 3 = 0, 5L, id % 7) AS id", "id AS pos")
    got = suffixes.repeated(rows.union(rows).repartition(16))
    assert got.count() == got.distinct().count() == 40_000 and got.where("key = 0").count() == 0
    one = rows.where("key = 0").union(spark.sql("SELECT 0L AS key, 6L AS id, 1L AS pos"))
    assert suffixes.repeated(one.repartition(8)).count() == 20_001
    assert suffixes.repeated(rows.limit(0)).count() == 0
