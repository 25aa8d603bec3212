"""Ordered run controls: cut-offs over a sequence, and provider fallback.

Each works on runs: rows of one run are ordered by a sequence column, in which no value
occurs twice. Where no run has more than LONG rows, running values are plain windows. A
longer run is never in one task: all rows are sorted by run and sequence into ranges, of
whatever type the sequence is, and a range's running values are its own and what the
ranges before it carry over, of which there is one row a range and run. Both give the same
rows. Cut-offs come from the least sequence value of a run, which is pre-aggregated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import scratch

#: Rows of a run that one window may hold.
LONG = 1_000_000


def _with(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the further columns of side, where its keys are equal (nulls too)."""
    named = side.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in side.columns if c not in keys])
    same = reduce(Column.__and__, [rows[k].eqNullSafe(named[f"_on_{k}"]) for k in keys])
    return rows.join(named, same, "left").drop(*[f"_on_{k}" for k in keys])


def _cut(rows: DataFrame, run: str, seq: str) -> tuple[DataFrame, bool]:
    """rows, and whether they have `_block`, the range that a row is in, as some run is long.

    Ranges are written once, since what is in one must not depend on when it is asked.
    """
    longest = rows.groupBy(run).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= LONG:
        return rows, False
    spark, at = rows.sparkSession, scratch(rows.sparkSession, "ranges")
    ranges = rows.repartitionByRange(F.col(run), F.col(seq)).withColumn("_block", F.spark_partition_id())
    ranges.write.parquet(at)
    return spark.read.schema(ranges.schema).parquet(at), True


def _running(rows: DataFrame, cut: bool, values: dict[str, tuple[Column, str]], run: str, seq: str) -> DataFrame:
    """rows of _cut() and, by name, the running sum or max of values over each run, a row's own included."""
    over = {"sum": F.sum, "max": F.max}
    keys = [run, "_block"] if cut else [run]
    inside = W.partitionBy(*keys).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    own = {name: over[how](value).over(inside) for name, (value, how) in values.items()}
    if not cut:
        return rows.withColumns(own)
    totals = rows.groupBy(*keys).agg(*[over[how](value).alias(f"_c_{name}") for name, (value, how) in values.items()])
    before = W.partitionBy(run).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, *[over[how](f"_c_{name}").over(before).alias(f"_c_{name}") for name, (_, how) in values.items()])
    out = _with(rows.withColumns(own), carried, keys)
    past = {name: F.col(f"_c_{name}") for name in values}
    both = {name: F.coalesce(F.col(name) + past[name], F.col(name), past[name]) if how == "sum" else F.greatest(name, past[name]) for name, (_, how) in values.items()}
    return out.withColumns(both).drop(*[f"_c_{name}" for name in values])


def running(rows: DataFrame, values: dict[str, tuple[Column, str]], run: str = "run_id", seq: str = "seq") -> DataFrame:
    """rows and, by name, the running sum or max of values over each run, a row's own included.

    The sequence is of any type that has an order.
    """
    return _running(*_cut(rows, run, seq), values, run, seq).drop("_block")


def circuit_breaker(rows: DataFrame, failed: Column, reset: Column, limit: int = 3, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """Rows up to the limit-th failure in a row, with `tripped` on that one.

    A reset row sets the count of failures to nothing; a row that is neither changes
    nothing. The tripping row stands for the sentinel: `remaining` is the number of rows
    after it, which are cut off.
    """
    marked = rows.withColumn("_failed", F.coalesce(failed, F.lit(False))).withColumn("_reset", F.coalesce(reset, F.lit(False)) & ~F.col("_failed"))
    ranges, cut = _cut(marked, run, seq)
    so_far = _running(ranges, cut, {"_fails": (F.col("_failed").cast("long"), "sum"), "_place": (F.lit(1).cast("long"), "sum")}, run, seq)
    since = _running(so_far, cut, {"_settled": (F.when(F.col("_reset"), F.col("_fails")), "max")}, run, seq).drop("_block")
    counted = since.withColumn("failures", F.col("_fails") - F.coalesce("_settled", F.lit(0))).withColumn("tripped", F.col("_failed") & (F.col("failures") >= limit))
    trips = counted.groupBy(run).agg(F.min(F.when(F.col("tripped"), F.struct(F.col(seq).alias("seq"), F.col("_place").alias("place")))).alias("_trip"), F.count("*").alias("_all"))
    kept = _with(counted, trips, [run]).where(F.col("_trip").isNull() | (F.col(seq) <= F.col("_trip.seq")))
    return kept.withColumn("remaining", F.when(F.col("tripped"), F.col("_all") - F.col("_trip.place"))).drop("_failed", "_reset", "_fails", "_place", "_settled", "_trip", "_all")


def _spent(rows: DataFrame, cost: str, run: str, seq: str, fixed: Column | None = None) -> DataFrame:
    out = running(rows, {"spent": (F.col(cost).cast("decimal(18,6)"), "sum")}, run, seq)
    return out.withColumn("spent", F.col("spent").cast("double") + (fixed if fixed is not None else F.lit(0.0)))


def budget_cutoff(rows: DataFrame, cost: str, budget: float, fixed: Column | None = None, warn_at: float = 0.8, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """Rows whose run stays below the budget; `spent` is the cost so far, with it.

    The row that reaches the budget is paid for, but not returned. fixed is a cost that
    each run has from the start. `warned` marks rows at or above warn_at of the budget.
    Costs are summed as decimals.
    """
    out = _spent(rows, cost, run, seq, fixed)
    ends = out.where(F.col("spent") >= budget).groupBy(run).agg(F.min(seq).alias("_end"))
    return _with(out, ends, [run]).where(F.col("_end").isNull() | (F.col(seq) < F.col("_end"))).drop("_end").withColumn("warned", F.col("spent") >= budget * warn_at)


def first_over(rows: DataFrame, cost: str, threshold: float = 0.5, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """Of each run the first row at which the cost so far reaches the threshold."""
    out = _spent(rows, cost, run, seq).where(F.col("spent") >= threshold)
    return out.groupBy(run).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in out.columns]), seq).alias("_row")).select("_row.*")


def stop_after(rows: DataFrame, stop: Column, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """Rows up to the first that says stop, that one included."""
    ends = rows.where(stop).groupBy(run).agg(F.min(seq).alias("_end"))
    return _with(rows, ends, [run]).where(F.col("_end").isNull() | (F.col(seq) <= F.col("_end"))).drop("_end")


def first_success(attempts: DataFrame) -> DataFrame:
    """The provider that answers each call of attempts (run_id, call_seq, rank, provider, outcome).

    A provider whose outcome is quota_exhausted or invalid_config is out for the rest of
    the run, so its attempts at later calls do not count. Among the others the first in
    rank whose outcome is ok answers; `provider` is null where all fail.
    """
    out = attempts.where(F.col("outcome").isin("quota_exhausted", "invalid_config")).groupBy("run_id", "provider").agg(F.min("call_seq").alias("_out"))
    live = _with(attempts, out, ["run_id", "provider"]).withColumn("_open", F.col("_out").isNull() | (F.col("call_seq") <= F.col("_out")))
    ok = F.col("_open") & (F.col("outcome") == "ok")
    return live.groupBy("run_id", "call_seq").agg(F.min_by(F.when(ok, F.col("provider")), F.when(ok, F.col("rank"))).alias("provider"), F.sum(F.when(F.col("_open"), 1).otherwise(0)).alias("open_providers"))


def backoff_schedule(attempts: int = 3, retry_after: float | None = None) -> list[float]:
    """Seconds to wait after each failed attempt: what the server asks for, else 2, 4, 8 .."""
    return [float(retry_after) if retry_after else float(2 ** (n + 1)) for n in range(attempts)]


def http_wait(status: int, attempt: int, retry_after: float | None = None, attempts: int = 3) -> float | None:
    """Seconds until a request is sent again, or None if it is not: 429 as the server asks
    or by the schedule, 5xx by the schedule, 401 and all else never."""
    if attempt + 1 >= attempts or not (status == 429 or status >= 500):
        return None
    return backoff_schedule(attempts, retry_after if status == 429 else None)[attempt]


def should_retry(outcome: Column) -> Column:
    """Whether an attempt at speech-to-text is repeated: not after lasting failures."""
    low = F.lower(F.coalesce(outcome, F.lit("")))
    lasting = low.contains("quota") | low.contains("unauthorized") | low.contains("forbidden") | low.contains("invalid api key")
    return (low != "ok") & ~lasting
