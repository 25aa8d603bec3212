"""Stores with several writers, and lookups that read parts of them."""

import datetime
import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from callweave.sources import commits, stores

AT = datetime.datetime(2024, 5, 1)
NOW = None  # a column, once there is a session


@pytest.fixture(autouse=True)
def now(spark):
    global NOW
    NOW = F.lit(AT).cast("timestamp")


def rows(spark, keys, value=1, days=0):
    return spark.createDataFrame([(k, AT - datetime.timedelta(days=days), value) for k in keys], "key string, cached_at timestamp, v int")


def store(spark, path, **options):
    return stores.Store(spark, str(path), 30, ["v"], **options)


def keys(s):
    return {r.key for r in s.entries(NOW).collect()}


def test_a_commit_is_made_once(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path))
    assert log.latest()[0] == 0
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if log.create(1, {"live": [str(i)], "removed": [], "kind": "put"}) else None) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and log.read(1)["live"] == [str(won[0])]
    assert [p.name for p in (tmp_path / "_log").iterdir() if p.name.endswith(".json") and not p.name.startswith(".")] == [f"{1:020}.json"]


def test_commits_of_many_writers(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path))
    threads = [threading.Thread(target=lambda i=i: log.commit(lambda now: {"live": [*now["live"], str(i)], "removed": [], "kind": "put"})) for i in range(10)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert log.versions() == list(range(1, 11)) and sorted(log.latest()[1]["live"], key=int) == [str(i) for i in range(10)]


def test_a_put_during_compact_is_not_lost(spark, tmp_path):
    s = store(spark, tmp_path)
    s.put(rows(spark, ["a", "b"]))
    write = s._write

    def between(df):
        name = write(df)
        s._write = write
        store(spark, tmp_path).put(rows(spark, ["c"]))  # after compact() has read, before it commits
        return name

    s._write = between
    assert s.compact(NOW) == 3 and keys(s) == {"a", "b", "c"}
    assert s.compact(NOW) == 3 and s.compact(NOW) == 3 and keys(s) == {"a", "b", "c"}


def test_a_put_that_began_before_compact_is_not_lost(spark, tmp_path):
    s, other = store(spark, tmp_path), store(spark, tmp_path)
    s.put(rows(spark, ["a"]))
    name = other._write(rows(spark, ["b"]))  # written, not committed
    s.compact(NOW)
    s.compact(NOW)
    other.log.commit(lambda now: {"live": [*now["live"], name], "removed": [], "kind": "put"})
    assert keys(s) == {"a", "b"}


def test_two_compacts_at_once(spark, tmp_path):
    s = store(spark, tmp_path)
    for k in "abc":
        s.put(rows(spark, [k]))
    write, met = s._write, []

    def between(df):
        name = write(df)
        if not met:
            met.append(store(spark, tmp_path).compact(NOW))
        return name

    s._write = between
    assert s.compact(NOW) == 3 and met == [3] and keys(s) == {"a", "b", "c"}


def test_clear_during_compact_wins(spark, tmp_path):
    s = store(spark, tmp_path)
    s.put(rows(spark, ["a"]))
    write = s._write

    def between(df):
        name = write(df)
        s._write = write
        store(spark, tmp_path).clear()
        return name

    s._write = between
    assert s.compact(NOW) == 0 and not s.exists() and keys(s) == set()


def test_real_threads(spark, tmp_path):
    s = store(spark, tmp_path, parts=2)
    s.put(rows(spark, ["seed"]))
    errors = []

    def run(f):
        try:
            f()
        except Exception as e:
            errors.append(e)

    work = [threading.Thread(target=run, args=(lambda i=i: store(spark, tmp_path, parts=2).put(rows(spark, [f"k{i}"])),)) for i in range(6)]
    work += [threading.Thread(target=run, args=(lambda: store(spark, tmp_path, parts=2).compact(NOW, tries=50),)) for _ in range(2)]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert not errors and keys(s) == {"seed", *(f"k{i}" for i in range(6))}


def test_the_newest_counts_and_old_ones_expire(spark, tmp_path):
    s = store(spark, tmp_path)
    s.put(rows(spark, ["a", "b"], 1, days=3))
    s.put(rows(spark, ["a"], 2))
    s.put(rows(spark, ["old"], 3, days=40))
    assert {(r.key, r.v) for r in s.entries(NOW).collect()} == {("a", 2), ("b", 1)}
    assert s.size() == 3 and s.compact(NOW) == 2


def test_lookup_reads_only_touched_parts(spark, tmp_path):
    s = store(spark, tmp_path, parts=8)
    s.put(rows(spark, [f"k{i}" for i in range(60)]))
    s.put(rows(spark, ["k3"], 9, days=-1))
    asked = spark.createDataFrame([("k3",), ("k5",), ("nobody",), ("k3",)], "key string")
    touched = {r[0] for r in asked.select(s.part(F.col("key"))).collect()}
    others = [f for f in Path(tmp_path).rglob("*.parquet") if int(f.parent.name.removeprefix("part=")) not in touched]
    assert others
    for f in others:
        f.write_bytes(f.read_bytes()[:-8] + b"rubbishX")  # who reads these, fails
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "false")
    s._read = lambda live, read=s._read: read(live)
    got = sorted((r.key, r.hit, r.v) for r in _unmerged(s).lookup(asked, NOW).collect())
    assert got == [("k3", True, 9), ("k3", True, 9), ("k5", True, 1), ("nobody", False, None)]
    with pytest.raises(Exception):
        _unmerged(s).size()


def _unmerged(s):
    """s with the columns of its first rows, since merging columns opens each file."""
    good = next(f for f in Path(s.path).rglob("*.parquet") if not f.read_bytes().endswith(b"rubbishX"))
    schema = s.spark.read.parquet(str(good)).schema.add("commit", StringType()).add("part", IntegerType())
    s._read = lambda live: s.spark.read.schema(schema).option("basePath", f"{s.path}/data").parquet(*[f"{s.path}/data/commit={c}" for c in live]).drop("commit")
    return s


def test_empty_store(spark, tmp_path):
    s = store(spark, tmp_path / "none")
    assert not s.exists() and s.size() == 0 and s.compact(NOW) == 0 and s.clear() == 0 and keys(s) == set()
    asked = spark.createDataFrame([("a",), (None,)], "key string")
    assert [r.hit for r in s.lookup(asked, NOW).collect()] == [False, False]


def test_what_a_crash_leaves_goes_later(spark, tmp_path):
    s = store(spark, tmp_path)
    s.put(rows(spark, ["a"]))
    s._write(rows(spark, ["lost"]))
    assert s.vacuum() == 0 and s.vacuum(older_than_s=-5) == 1 and keys(s) == {"a"}
    assert json.loads((tmp_path / "_log" / f"{1:020}.json").read_text())["kind"] == "put"
