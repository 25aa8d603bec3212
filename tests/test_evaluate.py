import os

import pytest
from pyspark.sql import functions as F

from callweave.operators import evaluate as ev
from callweave.sources import readers, stores

CRITERIA = {"opening": {"greets": {"weight": 2.0}}, "closing": {"thanks": {}}}


def test_a_whole_run(spark):
    long = "Speaker 0: hello there\nSpeaker 1: my name is Ann and I call about the trip\n" + "\n".join(f"Speaker {i % 2}: some more words to fill the call {i}" for i in range(20))
    rows = [(1, 1, "a.mp3", long, None, None), (1, 2, "b.mp3", "too short", "callback", None), (1, 3, "c.mp3", None, None, None), (1, 4, "d.mp3", long + "\nSpeaker 0: thank you", "callback", None)]
    df = spark.createDataFrame(rows, "run_id long, call_id long, filename string, transcript string, result string, status string")
    scorer = ev.RuleScorer({"greets": ["hello"], "thanks": ["thank you"]})
    results, details = ev.evaluate(df, readers.criteria(spark, CRITERIA), scorer)
    got = {r.call_id: r for r in results.collect()}
    assert (got[1].overall_score, got[1].error, got[1].method, got[1].agents) == (66.7, None, "intro", ["Ann"])
    assert (got[2].error, got[2].overall_score, got[2].call_type) == ("TOO_SHORT", None, "Follow-up Call")
    assert got[3].error == "TOO_SHORT" and got[4].overall_score == 100.0 and got[4].call_type == "Follow-up Call"
    assert {(r.call_id, r.key, r.weight) for r in details.collect()} == {(1, "greets", 2.0), (1, "thanks", 1.0), (4, "greets", 2.0), (4, "thanks", 1.0)}
    assert {r.call_id for r in ev.publish(results).collect()} == {1, 4}
    assert {r.call_id for r in ev.publish(results, limit=2).collect()} == {1}


def test_provider_chain():
    log, naps = [], []

    def failing(kind, times):
        state = {"n": 0}

        def call(prompt):
            state["n"] += 1
            log.append(kind)
            if state["n"] <= times:
                raise ev.ProviderError(kind, 1.5)
            return "late"

        return call

    chain = ev.Chain([("a", failing("quota_exhausted", 9)), ("b", failing("rate_limit", 1)), ("c", lambda p: "c")], naps.append)
    assert chain.ask("x") == ("b", "late") and naps == [1.5] and chain.disabled == {"a"}
    assert chain.ask("x") == ("b", "late") and log.count("quota_exhausted") == 1
    with pytest.raises(ev.ProviderError):
        ev.Chain([("a", failing("server_error", 9))], naps.append).ask("x")


def test_store(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "cache"), 7, ["text"], ["text"], max_entries=2)
    assert store.size() == 0 and store.clear() == 0
    at = F.to_timestamp(F.lit("2024-01-08 00:00:00"))
    rows = spark.createDataFrame([("k1", "2024-01-07 00:00:00", "new", "x"), ("k1", "2024-01-05 00:00:00", "old", "x"), ("k2", "2023-01-01 00:00:00", "v", "x"), ("k3", "2024-01-06 00:00:00", None, "x"), ("k4", "2024-01-07 01:00:00", "v", "x"), ("k5", "2024-01-06 01:00:00", "v", "x")], "key string, at string, text string, raw_response string")
    store.put(rows.withColumn("cached_at", F.to_timestamp("at")).drop("at"))
    entries = {r.key: r.text for r in store.entries(at).collect()}
    assert entries == {"k1": "new", "k4": "v", "k5": "v"} and "raw_response" not in store.entries(at).columns
    assert store.clear(dry_run=True) == 5
    assert store.compact(at) == 2 and {r.key for r in store.entries(at).collect()} == {"k1", "k4"}
    assert store.compact(at, spark.createDataFrame([("k4",)], "key string")) == 1
    assert store.clear() == 1 and not store.exists()


def test_recent_and_templates(tmp_path):
    recent = stores.Recent(2)
    for k in "abacab":
        recent.get(k, lambda k=k: k.upper())
    assert (recent.hits, recent.misses) == (2, 4)
    (tmp_path / "t.txt").write_text("hi {x}")
    assert stores.Templates(str(tmp_path)).load("t") == "hi {x}"


def test_lock(tmp_path):
    path = str(tmp_path / "lock")
    with stores.RunLock(path):
        with pytest.raises(FileExistsError), stores.RunLock(path):
            pass
    assert not os.path.exists(path)
    with open(path, "w") as f:
        f.write("broken")
    with stores.RunLock(path):
        pass
