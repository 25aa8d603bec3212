"""Content-addressed results: hits and misses, expiry, eviction and statistics.

A cache is a table with a key and cached_at; as_of is always given, so that a query gives
the same rows whenever it runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LLM_TTL_DAYS, STT_TTL_DAYS = 7, 30


def live(cache: DataFrame, as_of: Column, ttl_days: int, required: list[str] | None = None) -> DataFrame:
    """Entries not older than ttl_days whose required columns are all there."""
    out = cache.where((F.unix_timestamp(as_of) - F.unix_timestamp("cached_at")) <= ttl_days * 86400)
    for column in required or []:
        out = out.where(F.col(column).isNotNull())
    return out


def lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (key, ..) with the cache's columns and `hit`; keys of the cache are unique."""
    entries = cache.select("key", F.lit(True).alias("hit"), *[c for c in cache.columns if c != "key"])
    return requests.join(entries, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """One request per key that the cache lacks: equal requests are computed once."""
    return requests.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def orphans(cache: DataFrame, current: DataFrame) -> DataFrame:
    """Entries whose key is not among the current ones."""
    return cache.join(current.select("key"), "key", "left_anti")


def newest(cache: DataFrame, most: int) -> DataFrame:
    """The `most` latest entries; all of them if most is 0. Ties go to the smaller key.

    The rank is taken among the entries that a first pass leaves: limit() pre-selects in
    each task, so that no task sorts the whole cache.
    """
    return cache.orderBy(F.desc("cached_at"), "key").limit(most) if most else cache


def newest_per_group(cache: DataFrame, group: str, most: int) -> DataFrame:
    """The `most` latest entries of each group."""
    by = W.partitionBy(group).orderBy(F.desc("cached_at"), "key")
    return cache.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most).drop("_n")


def hit_rate(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """hits, misses, lookups and hit_rate (percent, one place) of an access log (hit boolean)."""
    from ..functions.numbers import exact_round

    hits = F.sum(F.col("hit").cast("long"))
    out = log.groupBy(*(by or [])).agg(F.coalesce(hits, F.lit(0)).alias("hits"), F.count("*").alias("lookups"))
    out = out.withColumn("misses", F.col("lookups") - F.col("hits"))
    return out.withColumn("hit_rate", exact_round(F.col("hits") / F.greatest(F.lit(1), F.col("lookups")) * 100, 1))


def two_level_rate(log: DataFrame) -> DataFrame:
    """Hit rate of a log with two levels (memory_hit, disk_hit boolean): either counts."""
    return hit_rate(log.withColumn("hit", F.coalesce("memory_hit", F.lit(False)) | F.coalesce("disk_hit", F.lit(False))))
