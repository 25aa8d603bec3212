import datetime
import decimal
import json
import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.functions import text
from callweave.operators import cache, calls, verdicts
from callweave.sources import readers, stores, writers
from callweave.streaming import metrics


def test_payload_is_flattened(spark, tmp_path):
    call = {"id": "c1", "started_at": "2024-05-01T10:00:00.1234567", "duration": 60, "recording_url": "https://x/1"}
    doc = {"success": True, "items": [{"id": 7, "status": "new", "agent": None, "client": {"first_name": "Ann", "last_name": None}, "calls": [call, {**call, "id": "c2", "direction": "inbound"}]}, {"id": 8, "calls": []}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    rows = calls.flatten(readers.call_payloads(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r.id, r.direction, r.client_name, r.agent_id) for r in rows] == [("c1", "", "Ann", None), ("c2", "inbound", "Ann", None)]


def test_first_record_of_an_id_stays(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 3, None)], "id string, seq int, v string")
    assert sorted(map(tuple, calls.keep_first(df, "id", "seq").collect())) == [("a", 1, "early"), ("b", 3, None)]
    assert sorted(map(tuple, calls.keep_first_ranked(df, "id", "seq").collect())) == [("a", 1, "early"), ("b", 3, None)]


def test_metric_log(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    assert writers.emit_metric(str(path), "llm_error", provider="p", status_code=500)
    assert not writers.emit_metric(str(tmp_path / "none" / "m.jsonl"), "x")
    with path.open("a") as f:
        f.write("broken\n")
    [r] = readers.metric_events(spark, str(path)).collect()
    assert (r.event, r.provider, r.status_code) == ("llm_error", "p", 500)


def test_run_log(spark, tmp_path):
    (tmp_path / "l.log").write_text("2026-02-12 10:00:01 [INFO] app.main [run.py:12] started: 3 files\nnot a log line\n")
    rows = readers.run_log(spark, str(tmp_path)).orderBy(F.col("level").isNull()).collect()
    assert (rows[0].level, rows[0].logger, rows[0].line, rows[0].message) == ("INFO", "app.main", 12, "started: 3 files")
    assert rows[1].message == "not a log line"


def test_audio_folder(spark, tmp_path):
    (tmp_path / "b.mp3").write_bytes(b"ID3" + b"x" * 2_000_000)
    (tmp_path / "a.wav").write_bytes(b"RIFFxxxx")
    (tmp_path / "n.txt").write_text("no audio")
    assert [(r.name, r.size_mb) for r in readers.audio_files(spark, str(tmp_path)).collect()] == [("a.wav", 0.0), ("b.mp3", 1.91)]
    assert {(r.name, r.format, r.error) for r in readers.audio_checks(spark, str(tmp_path)).collect()} == {("a.wav", "wav", None), ("b.mp3", "mp3", None)}


def test_audio_errors(spark):
    df = spark.createDataFrame([(b"",), (None,), (b"ID3x",)], "content binary")
    assert [r[0] for r in df.select(text.audio_error(F.col("content"))).collect()] == ["empty", "missing", None]
    assert df.select(text.audio_error(F.col("content"), most=2)).collect()[2][0] == "too_large"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a.mp3", "hi", 0.25, "secret")], "filename string, transcript string, cost_usd double, raw_text string")
    writers.write_document(df, str(tmp_path / "d"), "m", "2024-01-01")
    assert spark.read.json(str(tmp_path / "d/evaluations")).columns == ["cost_usd", "filename", "transcript"]
    assert spark.read.json(str(tmp_path / "d/metadata")).first().cost_usd == 0.25
    writers.write_transcripts(df.select("filename", "transcript"), str(tmp_path / "t"))
    writers.write_sheet(df, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 1


def test_webhook_retries():
    seen, waits = [], []

    def post(body, headers):
        seen.append(headers["X-Signature"])
        if len(seen) < 3:
            raise OSError
        return 204

    assert writers.notify({"b": 1, "a": 2}, "key", post, sleep=waits.append, rng=random.Random(1))
    assert len(set(seen)) == 1 and seen[0] == writers.signature({"a": 2, "b": 1}, "key")
    assert 1.5 <= waits[0] <= 2.5 and 3 <= waits[1] <= 5
    assert not writers.notify({}, "k", lambda *_: 500, sleep=waits.append)


def test_configuration():
    config = {"a": {"x": 1}, "b": None}
    assert readers.check_config(config, {"a": ["x", "y"], "b": ["z"], "c": []}) == ["b", "c", "a.y"]


def test_cache(spark):
    entries = spark.createDataFrame([("k1", "2024-01-01 00:00:00", "v"), ("k2", "2024-01-20 00:00:00", None)], "key string, at string, v string").withColumn("cached_at", F.to_timestamp("at")).drop("at")
    as_of = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    assert {r.key for r in cache.live(entries, as_of, 7).collect()} == {"k2"}
    assert cache.live(entries, as_of, 30, ["v"]).count() == 1
    requests = spark.createDataFrame([("k1",), ("k3",), ("k3",), (None,)], "key string")
    assert sorted(r.hit for r in cache.lookup(requests, entries).collect()) == [False, False, False, True]
    assert {r.key for r in cache.misses(requests, entries).collect()} == {"k3", None}
    assert {r.key for r in cache.newest(entries, 1).collect()} == {"k2"}
    assert cache.newest(entries, 0).count() == 2


def test_two_level_cache_rate(spark):
    log = spark.createDataFrame([(True, None), (False, True), (False, False)], "memory_hit boolean, disk_hit boolean")
    r = cache.two_level_rate(log).first()
    assert (r.hits, r.misses, r.hit_rate) == (2, 1, 66.7)


def test_short_audio(spark):
    df = spark.createDataFrame([(4.9,), (5.0,), (None,)], "s double")
    assert [r[0] for r in df.select(text.stt_status(F.col("s"))).collect()] == ["skipped_short", "pending", "pending"]


def test_stream_equals_batch(spark, tmp_path):
    for i in range(2):
        with (tmp_path / f"{i}.json").open("w") as f:
            for m in range(3):
                f.write(json.dumps({"timestamp": f"2024-01-01T00:0{m}:0{i}Z", "event": "llm_call"}) + "\n")
    stream = metrics.event_counts(metrics.metric_stream(spark, str(tmp_path)), "1 minute")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.event, r.n) for r in spark.table("counts").collect()) == [("llm_call", 2)] * 3


def test_text_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("  \n ",), ("a\xa0b c",)], "t string")
    rows = df.select(text.word_count(F.col("t")).alias("n"), text.clean(F.col("t")).alias("c"), text.too_short(F.col("t")).alias("s"), text.input_error(F.col("t")).alias("e")).collect()
    assert [r.n for r in rows] == [0, 0, 0, 3]
    assert [r.c for r in rows] == ["", "", "", "a\xa0b c"]
    assert all(r.s for r in rows) and [r.e for r in rows] == ["empty"] * 3 + [None]


def test_hostile_answers_are_no_json():
    """Deep nesting and endless numbers end no run."""
    for answer in ("[" * 200_000, '{"a":' * 100_000, "9" * 5000, '{"a": ' + "9" * 5000 + "}", "```json\n" + "[" * 50_000 + "\n```"):
        assert verdicts.find_json(answer) is None
    assert verdicts.find_json("x " + "9" * 5000 + ' {"a": 1}') == {"a": 1}


def test_missing_keys_are_named(spark):
    df = spark.createDataFrame([(list("abcdefg"),), (["a", "b"],), ([],)], "missing array<string>")
    assert [r[0] for r in df.select(verdicts.missing_note(F.col("missing"))).collect()] == ["Missing criteria: a, b, c, d, e and 2 more", "Missing criteria: a, b", None]


def test_ranges_drop_repeats(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2), (2, 2), (3, 3), (4, 4)], "id int, day int")
    got = calls.read_ranges([(1, 2), (3, 4)], lambda a, b: rows.where(F.col("day").between(a - 1, b)))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_compact_replaces_the_table_in_one_step(spark, tmp_path):
    at = datetime.datetime(2024, 5, 1)
    now = F.lit(at)
    store = stores.Store(spark, str(tmp_path / "s"), 30, ["v"], max_entries=2)
    store.put(spark.createDataFrame([(f"k{i}", at - datetime.timedelta(days=i), i) for i in range(5)], "key string, cached_at timestamp, v int"))
    before = store.current()
    reader = store.entries(now)
    live = spark.createDataFrame([("k3",), ("k4",), ("k9",)], "key string")
    assert store.compact(now, live) == 2  # orphans go before the limit counts
    assert {r.key for r in store.entries(now).collect()} == {"k3", "k4"}
    assert store.current() != before and {r.key for r in reader.collect()} == {f"k{i}" for i in range(5)}  # who reads the old version still can
    assert store.compact(now) == 2 and store.compact(now) == 2
    assert len(list((tmp_path / "s/data").iterdir())) == 2  # the one that counts and the one before
    assert store.clear(dry_run=True) == 2 and store.exists()
    assert store.clear() == 2 and not store.exists()


def test_values_without_a_json_form():
    values = {"p": pathlib.PurePosixPath("/a/b"), "t": datetime.datetime(2024, 5, 1, 2), "d": datetime.date(2024, 5, 1), "s": {3, 1}, "n": decimal.Decimal("1.5"), "b": b"\xffa", "i": np.int64(3), "f": np.float32(0.5), "a": np.arange(2)}
    assert json.loads(json.dumps(values, default=writers.plain)) == {"p": "/a/b", "t": "2024-05-01T02:00:00", "d": "2024-05-01", "s": [1, 3], "n": 1.5, "b": "\ufffda", "i": 3, "f": 0.5, "a": [0, 1]}
    with pytest.raises(TypeError):
        json.dumps(object(), default=writers.plain)


def test_requests_of_a_search(spark, tmp_path):
    items = [{"id": i, "created_at": f"2024-05-0{d}T10:00:00", "agent": {"id": a} if a else None, "calls": [{"id": str(i)}]} for i, (d, a) in enumerate([(1, 7), (2, 7), (3, None), (3, 7), (4, 8), (5, 7)])]
    for name, doc in {"a": {"success": True, "count": 6, "items": items + [{"id": 9, "calls": []}]}, "b": {"success": False, "message": "no"}, "c": {"success": True, "count": 0, "items": []}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    payloads = readers.call_payloads(spark, str(tmp_path))
    ids = lambda df: sorted(r.id for r in calls.flatten(df).collect())
    assert ids(calls.requested(payloads, "2024-05-02", "2024-05-04")) == ["1", "2", "3", "4"]
    assert ids(calls.requested(payloads, "2024-05-02", None, 7)) == ["1", "3", "5"]
    few = calls.requested(payloads, "2024-01-01", limit=2)
    assert ids(few) == ["0", "1"] and sorted(r.truncated for r in few.collect()) == [False, False, True]
    problems = payloads.select(calls.payload_problem(F.col("success"), F.col("count"), F.col("items"), F.col("message")).alias("p")).collect()
    assert sorted(str(r.p) for r in problems) == ["None", "count_mismatch: 6 reported, 7 received", "failed: no"]
