import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import nearcopies
from callweave.llm.common import materialise, run_dir
from tests.llm.test_simhash import brute_fingerprint


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts, ids):
    """The smallest id in reach over equal texts, short fingerprints within two bits and
    five-word sets of similarity 0.8, by comparing all pairs."""
    prints, sets, at = [brute_fingerprint(t) for t in texts], [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if texts[i] == texts[j] or (prints[i] ^ prints[j]).bit_count() <= 2 or (common and common >= 0.8 * len(sets[i] | sets[j])):
                at[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(ids))]


def variants(rng, words, n):
    """Copies of a text with a few words replaced."""
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, len(w) // 50)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def edited(rng, words, kind, least):
    """A near copy by one kind of edit that brings the similarity as close to least as it can, from above."""
    n, best = len(words), None
    for size in range(1, n):
        fresh = [f"e{rng.randrange(10**7)}" for _ in range(size)]
        if kind == "stretch":
            at = rng.randrange(n - size)
            new = words[:at] + fresh + words[at + size :]
        elif kind == "appended":
            new = words + fresh
        else:
            new = list(words)
            for i, w in zip(rng.sample(range(n), size), fresh, strict=True):
                new[i] = w
        a, b = shingles(" ".join(words)), shingles(" ".join(new))
        if len(a & b) < least * len(a | b):
            break
        best = new
    return best


@pytest.mark.parametrize("pairs_up_to", [2, nearcopies.PAIRS_UP_TO])
def test_near_copies_are_found(spark, monkeypatch, pairs_up_to):
    """What stays is what a comparison of all pairs leaves: scattered edits, replaced
    stretches and appended text down to the least similarity, and a large group."""
    monkeypatch.setattr(nearcopies, "PAIRS_UP_TO", pairs_up_to)
    rng = random.Random(6)
    texts = []
    for kind in ("scattered", "stretch", "appended"):
        for least in (0.8, 0.82, 0.85, 0.9):
            for size in (9, 30, 80, 200):
                words = [f"w{rng.randrange(10**7)}" for _ in range(size)]
                texts += [" ".join(words), " ".join(edited(rng, words, kind, least) or words)]
    licence = [f"l{i}" for i in range(60)]
    texts += [" ".join([*licence, *(f"m{rng.randrange(10**7)}" for _ in range(rng.randint(10, 140)))]) for _ in range(60)]
    texts += variants(rng, [f"h{i}" for i in range(150)], 60)
    texts += [" ".join(f"c{rng.randrange(9000)}" for _ in range(200)) for _ in range(40)] + ["one two", "One TWO", "one two three"]
    rng.shuffle(texts)
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    want = {i for i, c in zip(ids, brute_groups(texts, ids), strict=True) if i == c}
    assert {r.doc_id for r in nearcopies.one_of_each(df).collect()} == want


def test_signatures_meet():
    """Of two sets at the least similarity, at least slack(smaller) shingles of the signatures are the same."""
    rng = random.Random(2)
    for _ in range(400):
        a = rng.randint(1, 400)
        base = sorted(rng.sample(range(10**9), a))
        gone = rng.randint(0, a // 5)
        other = set(rng.sample(base, a - gone))
        while True:
            grown = other | {rng.randrange(10**9)}
            if len(set(base) & grown) < 0.8 * len(set(base) | grown):
                break
            other = grown
        if len(set(base) & other) < 0.8 * len(set(base) | other):
            continue
        x, y = (nearcopies.signature(np.array(sorted(s), np.uint64)) for s in (base, other))
        n, m = sorted((a, len(other)))
        assert len(np.intersect1d(x, y)) >= nearcopies.slack(n) > nearcopies.slack(nearcopies.need(m)) - 1


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nearcopies.one_of_each(empty).count() == 0
    rows = [(None, "a b c"), (None, "a b c"), (None, "d e f"), (3, None), (2, ""), (5, "a b c"), (5, "a b c"), (7, "x" * 100_000)]
    got = nearcopies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in got) == [("2", ""), ("5", "a b c"), ("5", "a b c"), ("7", "xxxxx"), ("None", "d e f")]


def test_large_blocks_are_settled(spark):
    """Of 30 texts in a block only three pairs are alike; each is found, whatever the hubs are."""
    alike = {(3, 17), (5, 29), (11, 12)}
    shared = spark.createDataFrame([(1, t, 50) for t in range(30)] + [(2, 3, 50), (2, 5, 50)], "key long, text_hash long, n int")
    links = spark.createDataFrame(sorted(alike), "a long, b long")
    none = spark.createDataFrame([], "node long, root long")
    either = links.union(links.select("b", "a"))
    roots = nearcopies.settled(shared, none, lambda pairs: pairs.join(either, ["a", "b"]))
    assert {(r.root, r.node) for r in roots.collect() if r.root != r.node} == alike


def test_an_original_links_its_copies_at_once(spark, monkeypatch):
    """Copies that are alike to their original but not to each other: pairs grow with the texts, not with their square."""
    rng, base = random.Random(4), [f"b{i}" for i in range(300)]
    texts = [" ".join(base)]
    for _ in range(150):
        words = list(base)
        for at in rng.sample(range(0, 295, 5), 6):
            words[at] = f"n{rng.randrange(10**7)}"
        texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert all(alike(sets[0], s) for s in sets) and not any(alike(sets[i], sets[j]) for i in range(1, 40) for j in range(1, i))
    counted, verified = [], nearcopies.verified
    monkeypatch.setattr(nearcopies, "verified", lambda pairs, sets: counted.append(pairs.count()) or verified(pairs, sets))
    df = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert [r.doc_id for r in nearcopies.one_of_each(df).collect()] == [850]
    assert sum(counted) <= 2 * len(texts)


def test_near_never_rules_out_near_copies():
    """Differing bits are at most differing shingles, over sets of all sizes and both foldings."""
    rng = random.Random(8)
    for _ in range(300):
        n = rng.choice([1, 2, 5, 31, 32, 33, 63, 64, 65, 128, 129, 500])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), n - rng.randint(0, n // 9))) | {rng.getrandbits(64) for _ in range(rng.randint(0, n // 9))}
        x, y = (nearcopies.parities(np.array(sorted(s), np.uint64)).view(np.uint64) for s in (a, b))
        small = min(len(x), len(y))
        x, y = (v[:small] ^ v[small:] if len(v) > small else v for v in (x, y))
        assert sum(int(d).bit_count() for d in x ^ y) <= len(a ^ b)


def test_near_folds_the_longer_one(spark):
    a, other = set(range(64 * 5, 64 * 5 + 1000, 31)), {5}
    b = set(sorted(a)[:31])
    rows = [(len(s), len(t), *(nearcopies.parities(np.array(sorted(v), np.uint64)).tolist() for v in (s, t))) for s, t in ((a, b), (b, a), (a, a), (set(sorted(a)[:20]), b), (other, {6}))]
    df = spark.createDataFrame(rows, "n int, m int, x array<long>, y array<long>")
    assert len(rows[0][2]) == 2 * len(rows[0][3])
    assert [r.near for r in df.select(nearcopies.near(*map(F.col, "nmxy")).alias("near")).collect()] == [True, True, True, False, False]


def test_only_what_goes_is_left_in_the_shared_folder(spark):
    path = Path(run_dir(spark).removeprefix("file://"))
    before = set(path.iterdir()) if path.exists() else set()
    df = spark.createDataFrame([(i, f"a b c d e f g {i // 2}") for i in range(60)], "doc_id long, text string")
    out = nearcopies.one_of_each(df)
    assert [p.name.split("-")[0] for p in set(path.iterdir()) - before] == ["copies"]
    assert out.count() == 30


def test_shuffle_files_go_with_their_query(spark):
    found = lambda: sum(len(list(Path(d.toString()).rglob("shuffle_*"))) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    before = found()
    materialise(spark.range(1000).groupBy(F.col("id") % 7).count(), "counts")
    assert found() <= before
