"""Run controls on a stream beside a loop over all rows in order."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from callweave.streaming import controls

T0 = datetime.datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def loop(rows, limit, budget, idle):
    """(run, seq, failures, spent, tripped) of rows (run, seconds, seq, kind, cost), run by run."""
    out, state = [], {}
    for run, second, seq, kind, cost in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        s = state.get(run)
        if s is None or second - s["last"] > idle:
            s = state[run] = {"failures": 0, "spent": 0, "over": False}
        s["last"] = second
        if s["over"]:
            continue
        s["spent"] += round((cost or 0) * 1_000_000)
        if s["spent"] >= round(budget * 1_000_000):
            s["over"] = True
            continue
        s["failures"] = s["failures"] + 1 if kind == "error" else 0 if kind == "purchase" else s["failures"]
        s["over"] = kind == "error" and s["failures"] >= limit
        out.append((run, seq, s["failures"], s["spent"] / 1e6, s["over"]))
    return sorted(out, key=str)


def feed(spark, path, rows, name):
    data = [(r, None if s is None else T0 + datetime.timedelta(seconds=s), q, k, c) for r, s, q, k, c in rows]
    spark.createDataFrame(data, "run_id long, ts timestamp, seq long, kind string, cost double").coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def drain(spark, folder, out, **options):
    """One start of the query over what has come so far; a further start goes on from there."""
    rows = spark.readStream.schema("run_id long, ts timestamp, seq long, kind string, cost double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    found = controls.controlled(rows, F.col("kind") == "error", F.col("kind") == "purchase", "cost", **options)
    q = found.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).format("parquet").start(f"{out}/rows")
    q.awaitTermination(240)
    assert q.exception() is None
    return sorted(map(tuple, spark.read.schema(found.schema).parquet(f"{out}/rows").collect()), key=str)


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream_equals_loop_with_late_rows_and_a_restart(spark, tmp_path, few_partitions):
    r = random.Random(2)
    rows = [(r.randrange(4), r.randrange(0, 6000), i, r.choice(["error", "error", "view", "purchase"]), r.choice([0.01, 0.02, None])) for i in range(160)]
    first, second = [x for x in rows if x[1] < 3000], [x for x in rows if x[1] >= 3000]
    r.shuffle(first)
    r.shuffle(second)
    folder, options = tmp_path / "in", {"limit": 3, "budget": 0.35, "delay": "10 minutes", "idle_seconds": 700.0}
    feed(spark, folder, first, "a")
    before = drain(spark, folder, tmp_path, **options)
    late = [(0, 5, 900, "error", 9.0), (None, None, 901, "view", 0.1)]  # far behind the watermark, and without a time
    feed(spark, folder, second + late, "b")
    drain(spark, folder, tmp_path, **options)  # from the checkpoint
    feed(spark, folder, [(77, 50_000, 999, "view", 0.0)], "c")
    got = drain(spark, folder, tmp_path, **options)
    want = loop(rows, 3, 0.35, 700)
    assert got == want and set(before) <= set(want) and 0 < len(before) < len(want) < len(rows)
    assert any(x[4] for x in want)


def test_stream_equals_batch_over_events(spark, tmp_path, few_partitions):
    """The whole table in three files by time; what no row is late for equals a loop over all rows."""
    e = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id AS run_id", "CAST(ts AS timestamp) AS ts", "event_id AS seq", "event_type AS kind", "value / 1000 AS cost")
    rows = [(x.run_id, float(x.s), x.seq, x.kind, float(x.c)) for x in e.selectExpr("run_id", "unix_millis(ts) / 1000.0D AS s", "seq", "kind", "CAST(cost AS decimal(18,6)) AS c").collect()]
    times = sorted(x[1] for x in rows)
    edges = [0.0, times[len(times) // 3], times[2 * len(times) // 3], times[-1] + 1]
    for i in range(3):
        part = e.where((F.unix_millis("ts") / 1000 >= edges[i]) & (F.unix_millis("ts") / 1000 < edges[i + 1]))
        part.repartition(1).write.parquet(str(tmp_path / f"in/{i}"))
    end = datetime.datetime.fromtimestamp(times[-1] + 10**7, datetime.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(-1, end, 0, "view", 0.0)], "run_id long, ts timestamp, seq long, kind string, cost double").coalesce(1).write.parquet(str(tmp_path / "in/9"))
    got = drain(spark, tmp_path / "in", tmp_path, limit=2, budget=0.5, delay="1 hour", idle_seconds=1e9)
    want = loop(rows, 2, 0.5, 1e9)
    assert got == want and 0 < len(want) < len(rows)


def test_decisions():
    row = lambda ms, failed=False, reset=False, micros=0: (ms, 0, failed, reset, micros)
    state, given, tripped = controls.decided(None, row(5, True), 2, 100, 10)
    assert (state, given, tripped) == ((1, 0, False, 5), True, False)
    state, given, tripped = controls.decided(state, row(7, True), 2, 100, 10)
    assert given and tripped and state[2]
    assert controls.decided(state, row(8), 2, 100, 10)[1] is False
    assert controls.decided(state, row(18), 2, 100, 10)[0] == (0, 0, False, 18)  # idle for longer
    assert controls.decided((1, 90, False, 1), row(2, micros=10), 2, 100, 10)[1] is False
    assert controls.decided((1, 0, False, 1), row(2, reset=True), 2, 100, 10)[0][0] == 0
