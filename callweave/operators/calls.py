"""Call records: flattening, de-duplication, download guards and range planning."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numbers import exact_round, stt_cost
from ..functions.text import basename, host


def flatten(payload: DataFrame, order: str | None = None) -> DataFrame:
    """Flat call records of a payload (items array of requests with an array of calls).

    Requests without calls give no row. `seq` orders the records: by the payload's order
    column, if it has one, then by their places in the payload. Without such a column the
    payload's own content takes its place, so that no order depends on how files are split.
    """
    row = F.col(order) if order else F.xxhash64(F.to_json("items"))
    items = payload.select(row.alias("_row"), F.posexplode("items").alias("_i", "r")).select("_row", "_i", "r", F.posexplode("r.calls").alias("_j", "c"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return items.select(
        F.struct("_row", "_i", "_j").alias("seq"),
        F.col("c.id").alias("id"),
        F.col("r.id").alias("flight_request_id"),
        F.col("c.started_at").alias("startTime"),
        F.col("c.duration").alias("duration"),
        text(F.col("c.direction")).alias("direction"),
        text(F.col("c.result")).alias("result"),
        F.col("c.recording_url").alias("recording_url"),
        F.col("r.agent.id").alias("agent_id"),
        F.col("r.agent.name").alias("agent_name"),
        F.trim(F.concat(text(F.col("r.client.first_name")), F.lit(" "), text(F.col("r.client.last_name")))).alias("client_name"),
        F.col("r.status").alias("flight_request_status"),
    )


def requested(payload: DataFrame, date_from: str, date_to: str | None = None, agent_id: int | None = None, limit: int = rules.API_LIMIT) -> DataFrame:
    """payload with those items that a search for days (year-month-day) and an agent asks for.

    limit is the service's own: so many requests come back at most, in the payload's order.
    `truncated` says whether it was reached, which is when a range of days is to be split.
    """

    def wanted(r: Column) -> Column:
        day = F.substring(r["created_at"], 1, 10)
        out = day >= date_from
        if date_to is not None:
            out = out & (day <= date_to)
        if agent_id is not None:
            out = out & r["agent"]["id"].eqNullSafe(F.lit(agent_id))
        return F.coalesce(out, F.lit(False))

    found = payload.withColumn("items", F.coalesce(F.filter("items", wanted), F.array().cast(payload.schema["items"].dataType)))
    return found.withColumn("truncated", F.size("items") >= limit).withColumn("items", F.slice("items", 1, limit))


def payload_problem(success: Column, count: Column, items: Column, message: Column) -> Column:
    """What is wrong with a payload: the service's message if it failed, or a count that does
    not fit; null if nothing is."""
    failed = F.concat(F.lit("failed: "), F.coalesce(message, F.lit("Unknown CRM API error")))
    found = F.coalesce(F.size(items), F.lit(0))
    return F.when(~F.coalesce(success, F.lit(False)), failed).when(count != found, F.concat(F.lit("count_mismatch: "), count.cast("string"), F.lit(" reported, "), found.cast("string"), F.lit(" received")))


def keep_first(rows: DataFrame, key: str, order: str | Column) -> DataFrame:
    """Of each key the row that comes first in order.

    A minimum by key, which is pre-aggregated before the shuffle, so that a key with very
    many rows does not gather in one task.
    """
    columns = rows.columns
    least = F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), order if isinstance(order, Column) else F.col(order))
    return rows.groupBy(key).agg(least.alias("_row")).select("_row.*")


def keep_first_ranked(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The same by a window, for rows that are already partitioned by key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def split_range(first: date, last: date, count: Callable[[date, date], int], limit: int = rules.API_LIMIT, depth: int = rules.SPLIT_DEPTH) -> tuple[list[tuple[date, date]], bool]:
    """Ranges of days, each below the limit of a source, and whether one may be cut short.

    A range that reaches the limit is halved at first + days // 2, at most depth times; a
    single day cannot be halved. The ranges serve as predicates of a partitioned read.
    """
    if count(first, last) < limit:
        return [(first, last)], False
    days = (last - first).days
    if depth == 0 or days < 1:
        return [(first, last)], True
    middle = first + timedelta(days=days // 2)
    left, cut_left = split_range(first, middle, count, limit, depth - 1)
    right, cut_right = split_range(middle + timedelta(days=1), last, count, limit, depth - 1)
    return left + right, cut_left or cut_right


def read_ranges(ranges: list[tuple[date, date]], read: Callable[[date, date], DataFrame], key: str = "id") -> DataFrame:
    """All records of the ranges; of records with one key, as at the edges, that of the first range.

    Within a range the least record stands for its key.
    """
    parts = [read(*r).withColumn("_range", F.lit(i)) for i, r in enumerate(ranges)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    plain = [f"`{c}`" for c, t in out.dtypes if c != "_range" and not t.startswith("map")]
    return keep_first(out, key, F.struct("_range", *plain)).drop("_range")


def download_guard(url: Column, allowed: str, status: Column | None = None, content_type: Column | None = None, size: Column | None = None) -> Column:
    """Why a recording is not taken: no_url, foreign_host, http_error, html, too_large or
    empty; null if it is. Only what is known is checked."""
    out = F.when(url.isNull() | (url == ""), "no_url").when(~host(url).eqNullSafe(F.lit(allowed.lower())), "foreign_host")
    if status is not None:
        out = out.when(status != 200, "http_error")
    if content_type is not None:
        out = out.when(F.lower(F.coalesce(content_type, F.lit(""))).contains("text/html"), "html")
    if size is not None:
        out = out.when(size > rules.MAX_FILE_BYTES, "too_large").when(size == 0, "empty")
    return out


def recording_name(call_id: Column, started: Column) -> Column:
    return F.concat(call_id.cast("string"), F.lit("_"), F.replace(F.substring(F.coalesce(started.cast("string"), F.lit("")), 1, 10), F.lit("-"), F.lit("")), F.lit(".mp3"))


def metadata(calls: DataFrame) -> DataFrame:
    """Of calls with a local file, what later steps need, by file name."""
    return calls.where("local_audio_path is not null").select(basename(F.col("local_audio_path")).alias("filename"), "direction", "agent_name", "client_name", "result", "flight_request_status", F.col("id").alias("call_id"))


def with_metadata(transcripts: DataFrame, records: DataFrame) -> DataFrame:
    """transcripts with the call's metadata where a file of that name has any; own values win."""
    shared = [c for c in transcripts.columns if c in records.columns and c != "filename"]
    renamed = records.select("filename", *[F.col(c).alias(f"_{c}") if c in shared else F.col(c) for c in records.columns if c != "filename"])
    out = transcripts.join(renamed, "filename", "left")
    for c in shared:
        out = out.withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
    return out


def dry_run(files: DataFrame, cached: DataFrame, budget: float | None = None) -> DataFrame:
    """Totals of what a run over files (key, minutes) would cost, given the cached keys."""
    known = files.join(cached.select("key").distinct().withColumn("_hit", F.lit(True)), "key", "left")
    cost = F.when(F.col("_hit"), 0).otherwise(stt_cost(F.col("minutes"))).cast("decimal(18,4)")
    out = known.agg(F.count("*").alias("files"), F.count("_hit").alias("cached"), F.coalesce(F.sum(cost), F.lit(0)).cast("double").alias("stt_cost"))
    out = out.withColumn("llm_cost", exact_round(F.col("files") * rules.LLM_USD_PER_CALL, 4))
    total = exact_round(F.col("stt_cost") + F.col("llm_cost"), 4)
    return out.withColumn("total_cost", total).withColumn("over_budget", F.lit(False) if budget is None else total > budget)
