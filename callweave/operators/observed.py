"""Metrics out of the run itself: totals that are counted while rows are written, not afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.writers import emit_metric


def _metrics(kinds: list[str], column: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), *[F.count(F.when(F.col(column) == k, 1)).alias(f"n_{i}") for i, k in enumerate(kinds)]]


def observed(rows: DataFrame, kinds: list[str], column: str = "event") -> tuple[DataFrame, Observation]:
    """rows, and what an action on them will have counted: see totals()."""
    seen = Observation()
    return rows.observe(seen, *_metrics(kinds, column)), seen


def totals(spark: SparkSession, seen: Observation, kinds: list[str], column: str = "event") -> DataFrame:
    """The kind and n of each kind that occurred, once the action is over; other values are one kind, null, as are nulls.

    Waits for the action. A handful of numbers comes from it, whatever the rows are.
    """
    got = seen.get
    named = [(k, got[f"n_{i}"]) for i, k in enumerate(kinds)]
    rest = got["rows"] - sum(n for _, n in named)
    return spark.createDataFrame([r for r in [*named, (None, rest)] if r[1]], f"{column} string, n long")


class MetricListener(StreamingQueryListener):
    """Appends what each batch of each stream has done to a metric log: rows, duration and observed metrics."""

    def __init__(self, path: str):
        self.path = path

    def onQueryStarted(self, event) -> None:
        emit_metric(self.path, "stream_started", query=str(event.id), name=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        metrics = {name: row.asDict() for name, row in (p.observedMetrics or {}).items()}
        emit_metric(self.path, "stream_batch", query=str(p.id), batch=p.batchId, rows=p.numInputRows, duration_ms=p.batchDuration, observed=metrics)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        emit_metric(self.path, "stream_ended", query=str(event.id), error=event.exception)
