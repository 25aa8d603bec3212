"""Totals that a run counts itself, beside a second pass over its rows."""

import json
import time

from pyspark.sql import functions as F

from callweave.operators import observed
from callweave.sources import readers


def test_totals_equal_a_second_pass(spark, tmp_path):
    df = spark.range(1000).select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("x"), F.lit(None)), (F.col("id") % 4 + 1).cast("int")).alias("event")).repartition(5)
    rows, seen = observed.observed(df, ["a", "b", "never"])
    rows.write.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, observed.totals(spark, seen, ["a", "b", "never"]).collect()), key=str) == [("a", 250), ("b", 250), (None, 500)]
    rows, seen = observed.observed(df.limit(0), ["a"])
    rows.write.parquet(str(tmp_path / "none"))
    assert observed.totals(spark, seen, ["a"]).count() == 0


def test_batches_of_a_stream_are_logged(spark, tmp_path):
    for i in range(3):
        spark.range(10 * (i + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = tmp_path / "metrics.jsonl"
    listener = observed.MetricListener(str(log))
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("totals", F.count(F.lit(1)).alias("n"))
        q = rows.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        q.awaitTermination(120)
        until = time.time() + 30
        while time.time() < until and not (log.exists() and "stream_ended" in log.read_text()):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    events = [json.loads(x) for x in log.read_text().splitlines()]
    batches = [e for e in events if e["event"] == "stream_batch" and e["rows"]]
    assert sorted(e["observed"]["totals"]["n"] for e in batches) == sorted(e["rows"] for e in batches) == [10, 20, 30]
    assert [e["event"] for e in events][0] == "stream_started" and events[-1]["error"] is None
    assert {r.event for r in readers.metric_events(spark, str(log)).collect()} >= {"stream_started", "stream_batch", "stream_ended"}
