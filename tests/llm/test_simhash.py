import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from callweave.llm import graph, simhash


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, ids):
    at = {f: f for f in prints}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    distinct = sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                at[find(a)] = find(b)
    least = {}
    for f, i in zip(prints, ids, strict=True):
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [least.get(find(f)) for f in prints]


TEXTS = ["", None, " \t\n", "one", "One  TWO", "one two", "a b c", "A B C", "É é b c d", "a b c d e f g " * 300, "\x1cx \x85y z", "word word a b"]


def test_fingerprints(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, fp string")
    rows = simhash.fingerprints(df).select("doc_id", simhash.hex64(F.col("fp")).alias("h")).collect()
    assert {r.doc_id: int(r.h, 16) for r in rows} == {i: brute_fingerprint(t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("pairs_up_to", [0, 3, 1000])
def test_links_connect_what_is_close(spark, monkeypatch, pairs_up_to):
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", pairs_up_to)
    rng = random.Random(9)
    prints = []
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            prints.append(f)
            f ^= 1 << rng.randrange(64) ^ (rng.choice([0, 1]) << rng.randrange(64))
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in prints], "fp long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(nodes).collect()]
    assert all(0 < (a ^ b).bit_count() <= 2 for a, b in links)
    roots = {r.node % 2**64: r.root for r in graph.connected_components(simhash.links(nodes)).collect()}
    want = brute_components(prints, list(range(len(prints))))
    groups = {}
    for f, c in zip(prints, want, strict=True):
        groups.setdefault(c, set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_groups_and_survivors(spark):
    base = " ".join(f"w{i}" for i in range(4000))
    texts = ["copy me now please", base, "copy me now please", base.replace("w2000", "other"), "", None, "alone here", "COPY me now please"]
    ids = [5, 3, 2, 9, 7, 8, 4, None]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    prints = [brute_fingerprint(t) for t in texts]
    want = brute_components(prints, ids)
    got = {(r.doc_id): r.component_id for r in simhash.groups(df).collect()}
    assert got == dict(zip(ids, want, strict=True))
    stay = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert stay == {i for i, c in zip(ids, want, strict=True) if i == c}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "d e f")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.one_of_each(nulls).collect()) == ["a b c", "a b c", "d e f"]
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert simhash.groups(twice).count() == 2


def test_a_long_chain_is_one_component(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(7, 7), (500, 501)], "a long, b long")
    got = {r.node: r.root for r in graph.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 500: 500, 501: 500}
