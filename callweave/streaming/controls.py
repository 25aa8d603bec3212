"""Run controls on a stream: breaker and budget of each run as state, in event time.

Rows of a run may come in any order within the watermark's delay. They wait in the state
until the watermark has passed them, and are then taken in order, so that the stream
decides as a batch over all rows that were in time. The state of a run is what waits, four
numbers and a flag; it goes when nothing has come for `idle`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_WAITING = "ms long, seq long, failed boolean, reset boolean, micros long"
_TOTALS = "failures long, micros long, ended boolean, last_ms long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decided(totals: tuple[int, int, bool, int] | None, row: tuple[int, int, bool, bool, int], limit: int, budget: int, idle: int) -> tuple[tuple[int, int, bool, int], bool, bool]:
    """(totals after a row, whether it is given out, whether it trips the breaker).

    totals: failures in a row, cost so far, whether the run has ended, time of the last row.
    A row that reaches the budget ends the run and is not given out; one that trips the
    breaker ends it and is. Longer than `idle` after its last row a run begins anew.
    """
    ms, _, failed, reset, micros = row
    failures, spent, ended, last = totals if totals and ms - totals[3] <= idle else (0, 0, False, ms)
    last = max(last, ms)
    if ended:
        return (failures, spent, True, last), False, False
    spent += micros
    if spent >= budget:
        return (failures, spent, True, last), False, False
    failures = failures + 1 if failed else 0 if reset else failures
    tripped = failed and failures >= limit
    return (failures, spent, tripped, last), True, tripped


class RunControl(StatefulProcessor):
    def __init__(self, limit: int, budget: int, idle: int, key: str):
        self.limit, self.budget, self.idle, self.key = limit, budget, idle, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.totals = handle.getValueState("totals", _TOTALS)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            new = [(int(a), int(b), bool(c), bool(d), int(e)) for a, b, c, d, e in part[["ms", "seq", "failed", "reset", "micros"]].itertuples(index=False)]
            if new:
                self.waiting.appendList(new)
                first = min(r[0] for r in new) if first is None else min(first, *(r[0] for r in new))
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        every = [tuple(r) for r in self.waiting.get()]
        due = sorted(r for r in every if r[0] <= now)
        later = [r for r in every if r[0] > now]
        totals = tuple(self.totals.get()) if self.totals.exists() else None
        out = []
        for row in due:
            totals, given, tripped = decided(totals, row, self.limit, self.budget, self.idle)
            if given:
                out.append((key[0], row[1], totals[0], totals[1] / 1e6, tripped))
        if due:
            self.waiting.clear()
            if later:
                self.waiting.appendList(later)
        if later:
            self.handle.registerTimer(min(r[0] for r in later))
        if totals and not later and totals[3] + self.idle < now:
            self.totals.clear()
        elif totals:
            self.totals.update(totals)
            if not later:
                self.handle.registerTimer(totals[3] + self.idle + 1)
        if out:
            yield pd.DataFrame(out, columns=[self.key, "seq", "failures", "spent", "tripped"])

    def close(self) -> None:
        pass


def controlled(rows: DataFrame, failed: Column, reset: Column, cost: str, limit: int = 3, budget: float = 1.0, run: str = "run_id", seq: str = "seq", ts: str = "ts", delay: str = "10 minutes", idle_seconds: float = 86_400.0) -> DataFrame:
    """A stream's rows (run, seq, failures, spent, tripped) up to where the breaker or the budget ends their run.

    rows are ordered by ts and, at one time, by seq (a long). Null flags are no, null costs
    nothing, and rows without a time have no place in a run and go; costs are counted in
    millionths. Rows later than `delay` are dropped by the watermark. The last rows come
    out once the watermark has passed them. Sets the session's state store to RocksDB,
    which this kind of state needs.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    yes = lambda c: F.coalesce(c, F.lit(False))
    flat = rows.where(F.col(ts).isNotNull()).select(
        F.col(run), F.col(ts).alias("ts"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col(seq).cast("long").alias("seq"), yes(failed).alias("failed"), (yes(reset) & ~yes(failed)).alias("reset"),
        (F.coalesce(F.col(cost).cast("decimal(18,6)"), F.lit(0)) * 1_000_000).cast("long").alias("micros"),
    )
    kind = rows.schema[run].dataType.simpleString()
    processor = RunControl(limit, round(budget * 1_000_000), round(idle_seconds * 1000), run)
    return flat.withWatermark("ts", delay).groupBy(run).transformWithStateInPandas(processor, f"`{run}` {kind}, seq long, failures long, spent double, tripped boolean", "Append", "EventTime")
