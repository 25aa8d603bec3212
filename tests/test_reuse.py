"""Reuse distances beside an ordered dictionary."""

import random
from collections import OrderedDict

import numpy as np
import pytest

from callweave.operators import reuse

SF = "/root/testdata/sf0.001"


def simulate(keys, size):
    held, hits = OrderedDict(), 0
    for k in keys:
        if k in held:
            hits += 1
            held.move_to_end(k)
        else:
            held[k] = True
            if len(held) > size:
                held.popitem(last=False)
    return hits


def straight(keys):
    last, out = {}, []
    for i, k in enumerate(keys):
        out.append(len(set(keys[last[k] + 1 : i])) if k in last else None)
        last[k] = i
    return out


def test_pairs_in_order():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 200):
        x, y = r.integers(0, max(1, n // 3), n), r.permutation(n)
        assert reuse.before_and_below(x, y).tolist() == [int(((x < a) & (y < b)).sum()) for a, b in zip(x, y, strict=True)]


@pytest.mark.parametrize("blocks, rows", [(1000, 1 << 16), (1000, 7), (4, 1), (1, 1)])
def test_distances_equal_a_loop(spark, blocks, rows):
    r = random.Random(blocks + rows)
    keys = [r.choice([None, "hot", "hot", *"abcdefghijklmnop"]) for _ in range(220)]
    df = spark.createDataFrame([(k, i // 3, i) for i, k in enumerate(keys)], "k string, t long, i long").repartition(4)
    got = sorted((x.place, x.key, x.distance) for x in reuse.distances(df, "k", ["t", "i"], blocks, rows).collect())
    assert [g[1] for g in got] == keys and [g[2] for g in got] == straight(keys)


def test_hits_equal_an_ordered_dictionary(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    keys = [x.user_id for x in e.orderBy("ts", "event_id").collect()]
    sizes = [1, 3, 5, 10, 100]
    got = {x["size"]: x.hits for x in reuse.lru_hits(reuse.distances(e, "user_id", ["ts", "event_id"], block_rows=100), sizes).collect()}
    assert got == {s: simulate(keys, s) for s in sizes} and 0 < got[3] < got[10]


def test_empty_log(spark):
    df = spark.createDataFrame([], "k string, i long")
    assert reuse.distances(df, "k", ["i"]).count() == 0
    assert [tuple(r) for r in reuse.lru_hits(reuse.distances(df, "k", ["i"]), [2]).collect()] == [(2, 0, 0, 0)]
