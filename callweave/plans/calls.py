"""Queries on call records, caches and estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numbers import exact_round_sql as rnd
from ..operators import cache, calls, report, reuse
from ..sources import callsource, stores
from ..sources.readers import PAYLOAD  # noqa: F401  the shape that flatten() takes
from ..sources.shared import scratch
from . import base
from .base import pick, pick_sql, query


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "orders")


@query("dedupe_keep_first", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderstatus", F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return calls.keep_first(rows, "o_custkey", "seq").drop("seq")


@query(
    "flatten_nested",
    """SELECT o_orderkey::VARCHAR AS id, c_custkey AS flight_request_id, strftime(o_orderdate, '%Y-%m-%d') AS "startTime", (o_orderkey % 900)::INT AS duration, CASE WHEN o_orderkey % 2 = 0 THEN 'inbound' ELSE '' END AS direction, o_orderstatus AS result,
  'https://calls.example.com/' || o_orderkey AS recording_url, c_nationkey::BIGINT AS agent_id, 'Agent ' || c_nationkey AS agent_name, c_name AS client_name, c_mktsegment AS flight_request_status FROM customer JOIN orders ON c_custkey = o_custkey""",
)
def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"), (F.col("o_orderkey") % 900).cast("int").alias("duration"),
        F.when(F.col("o_orderkey") % 2 == 0, "inbound").alias("direction"), F.col("o_orderstatus").alias("result"), F.concat(F.lit("https://calls.example.com/"), "o_orderkey").alias("recording_url"),
    )
    by = _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(one).alias("calls"))
    request = F.struct(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.struct(F.col("c_nationkey").cast("long").alias("id"), F.concat(F.lit("Agent "), "c_nationkey").alias("name")).alias("agent"),
        F.struct(F.col("c_name").alias("first_name"), F.lit(None).cast("string").alias("last_name")).alias("client"), "calls",
    )
    payload = base.table(spark, sf_dir, "customer").join(by, "c_custkey", "left").select(F.array(request).alias("items"))
    return calls.flatten(payload).drop("seq")


@query(
    "search_requests",
    """WITH o AS (SELECT c_custkey, o_orderkey, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' AND c_nationkey < 20),
n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY c_custkey) >= 5 AS truncated FROM o)
SELECT c_custkey, o_orderkey::VARCHAR AS id, truncated FROM n WHERE n <= 5""",
)
def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload a customer, and of its requests those of three years and one agent, five at most."""
    request = F.struct(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.lit(None).cast("string").alias("status"),
        F.struct(F.when(F.col("c_nationkey") < 20, F.lit(7).cast("long")).alias("id"), F.lit(None).cast("string").alias("name")).alias("agent"), F.struct(F.lit("A").alias("first_name"), F.lit("B").alias("last_name")).alias("client"),
        F.array(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit(None).cast("string").alias("started_at"), F.lit(1).alias("duration"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("recording_url"))).alias("calls"),
    )
    rows = base.table(spark, sf_dir, "customer").join(_orders(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"))
    payload = rows.groupBy("c_custkey").agg(F.array_sort(F.collect_list(request)).alias("items"))
    found = calls.requested(payload, "1995-01-01", "1997-12-31", 7, 5)
    return found.select("c_custkey", "truncated", F.explode("items").alias("r")).select("c_custkey", F.get("r.calls", 0)["id"].alias("id"), "truncated")


_URLS = ["https://rec.example.com/a.mp3", "http://REC.example.com:8443/b", "https://evil.example.net/rec.example.com", "", None, "ftp://user@rec.example.com/x", "not a url"]


@query("url_host_guard", f"SELECT o_orderkey, CASE WHEN coalesce(u, '') = '' THEN 'no_url' WHEN lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) <> 'rec.example.com' THEN 'foreign_host' END AS reason FROM (SELECT o_orderkey, {pick_sql(_URLS, 'o_orderkey')} AS u FROM orders)")
def url_host_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", calls.download_guard(pick(_URLS, F.col("o_orderkey")), "rec.example.com").alias("reason"))


@query("page_host_counts", "SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY ALL")
def page_host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import host

    return base.table(spark, sf_dir, "pages").groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("recording_names", "SELECT o_orderkey, o_orderkey || '_' || strftime(o_orderdate, '%Y%m%d') || '.mp3' AS name FROM orders")
def recording_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", calls.recording_name(F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("name"))


@query("metadata_left_join", "SELECT o_orderkey || '.mp3' AS filename, o_orderstatus AS status, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 'own' END, c_mktsegment) AS result, c_name AS client_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def metadata_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _orders(spark, sf_dir).select(F.col("o_custkey").alias("filename"), F.concat("o_orderkey", F.lit(".mp3")).alias("name"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 4 == 0, "own").alias("result"))
    records = base.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("filename"), F.col("c_mktsegment").alias("result"), F.col("c_name").alias("client_name"))
    return calls.with_metadata(own, records).select(F.col("name").alias("filename"), "status", "result", "client_name")


_CACHE = "(SELECT o_orderkey AS key, o_orderdate AS cached_at, o_totalprice AS value, CASE WHEN o_orderkey % 10 > 0 THEN o_orderstatus END AS text FROM orders WHERE o_orderkey % 3 <> 1)"
_AS_OF = "1998-06-01 00:00:00"


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).where("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("cached_at"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderstatus")).alias("text"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"))


@query("cache_hit_split", f"SELECT l_orderkey AS key, l_linenumber AS n, l_partkey AS part, c.key IS NOT NULL AS hit, c.value FROM lineitem LEFT JOIN {_CACHE} c ON l_orderkey = c.key")
def cache_hit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.lookup(_requests(spark, sf_dir), _cache(spark, sf_dir).drop("cached_at", "text"))


@query(
    "cache_store_lookup",
    f"SELECT l_orderkey AS key, l_linenumber AS n, c.key IS NOT NULL AS hit, c.value FROM lineitem LEFT JOIN (SELECT key, value FROM {_CACHE} WHERE epoch(TIMESTAMP '{_AS_OF}') - epoch(cached_at) <= 30 * 86400 AND text IS NOT NULL) c ON l_orderkey = c.key",
)
def cache_store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests beside a stored cache: older entries, the current ones, a rewrite, and a lookup."""
    as_of, rows = F.lit(_AS_OF).cast("timestamp"), _cache(spark, sf_dir)
    rows = rows.withColumn("cached_at", F.col("cached_at").cast("timestamp"))
    store = stores.Store(spark, scratch(spark, "cache"), cache.STT_TTL_DAYS, ["text"], parts=16)
    store.put(rows.where("text is not null").withColumn("cached_at", F.col("cached_at") - F.expr("INTERVAL 1 SECOND")).withColumn("value", -F.col("value")))
    store.put(rows)
    store.compact(as_of)
    return store.lookup(_requests(spark, sf_dir).select("key", "n"), as_of).select("key", "n", "hit", "value")


@query("cache_misses_distinct", f"SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT key FROM {_CACHE})")
def cache_misses_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.misses(_requests(spark, sf_dir).select("key"), _cache(spark, sf_dir))


@query("cache_hit_rate", f"WITH l AS (SELECT l_linenumber AS n, l_orderkey IN (SELECT key FROM {_CACHE}) AS hit FROM lineitem) SELECT n, count(*) FILTER (WHERE hit) AS hits, count(*) AS lookups, count(*) FILTER (WHERE NOT hit) AS misses, {rnd('(count(*) FILTER (WHERE hit) / greatest(1, count(*)) * 100)', 1)} AS hit_rate FROM l GROUP BY n")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.hit_rate(cache.lookup(_requests(spark, sf_dir), _cache(spark, sf_dir).select("key")), ["n"])


_SIZES = [5, 20, 60, 200, 600]


@query(
    "lru_hits_by_size",
    f"""WITH a AS (SELECT user_id || ':' || event_type AS key, row_number() OVER (ORDER BY ts, event_id) AS i FROM events), p AS (SELECT i, lag(i) OVER (PARTITION BY key ORDER BY i) AS p FROM a),
d AS (SELECT x.i, count(y.i) AS distance FROM p x LEFT JOIN p y ON y.i > x.p AND y.i < x.i AND coalesce(y.p, 0) < x.p WHERE x.p IS NOT NULL GROUP BY x.i)
SELECT size::INT AS size, (SELECT count(*) FROM d WHERE distance < size) AS hits, (SELECT count(*) FROM events) - (SELECT count(*) FROM d WHERE distance < size) AS misses, (SELECT count(*) FROM events) AS lookups FROM (SELECT unnest({_SIZES}) AS size)""",
)
def lru_hits_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of caches of several sizes over the log of a user's kinds of events."""
    log = base.table(spark, sf_dir, "events").withColumn("key", F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type"))
    return reuse.lru_hits(reuse.distances(log, "key", ["ts", "event_id"]), _SIZES)


@query("ttl_filter", f"SELECT key, value, text FROM {_CACHE} WHERE epoch(TIMESTAMP '{_AS_OF}') - epoch(cached_at) <= 30 * 86400 AND text IS NOT NULL")
def ttl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.live(_cache(spark, sf_dir), F.lit(_AS_OF).cast("timestamp"), cache.STT_TTL_DAYS, ["text"]).drop("cached_at")


@query("anti_join_orphans", f"SELECT key, value FROM {_CACHE} WHERE key NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_join_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.orphans(_cache(spark, sf_dir), _requests(spark, sf_dir)).select("key", "value")


@query("lru_keep_n", f"SELECT key, cached_at, value FROM {_CACHE} ORDER BY cached_at DESC, key LIMIT 100")
def lru_keep_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.newest(_cache(spark, sf_dir), 100).select("key", "cached_at", "value")


@query("lru_keep_n_per_group", f"SELECT key, text, value FROM {_CACHE} WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY cached_at DESC, key) <= 50")
def lru_keep_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.newest_per_group(_cache(spark, sf_dir).where("text is not null"), "text", 50).select("key", "text", "value")


@query(
    "dry_run_estimate",
    f"""WITH f AS (SELECT o_orderkey, CASE WHEN c.key IS NULL THEN {rnd('(o_totalprice / 10000 * 0.005::DOUBLE)', 4)} ELSE 0 END::DECIMAL(18,4) AS cost, c.key FROM orders LEFT JOIN {_CACHE} c ON o_orderkey = c.key),
t AS (SELECT count(*) AS files, count(key) AS cached, CAST(sum(cost) AS DOUBLE) AS stt_cost FROM f), u AS (SELECT *, {rnd('(files * 0.003::DOUBLE)', 4)} AS llm_cost FROM t)
SELECT *, {rnd('(stt_cost + llm_cost)', 4)} AS total_cost, {rnd('(stt_cost + llm_cost)', 4)} > 100 AS over_budget FROM u""",
)
def dry_run_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") / 10000).alias("minutes"))
    return calls.dry_run(files, _cache(spark, sf_dir), 100.0)


@query(
    "stt_summary",
    "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS succeeded, CAST(sum((o_totalprice / 1e6)::DECIMAL(18,6)) AS DOUBLE) AS cost, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS cache_hits, CAST(sum(CASE WHEN o_orderkey % 4 = 0 THEN (o_totalprice / 1000)::DECIMAL(18,6) END) AS DOUBLE) * 0.005::DOUBLE AS saved FROM orders",
)
def stt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).select(F.when(F.col("o_orderstatus") == "F", "Success").otherwise("Error").alias("status"), (F.col("o_totalprice") / 1e6).alias("cost_usd"), (F.col("o_orderkey") % 4 == 0).alias("cached"), (F.col("o_totalprice") / 1000).alias("minutes"))
    return report.stt_summary(o)


def _service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the records of a call service, laid out by month and day, to be searched."""
    void = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in callsource.RECORD.split(", ")}
    own = {"id": F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), "day": F.to_date("o_orderdate"), "agent_id": F.col("o_custkey") % 7, "flight_request_id": F.col("o_custkey"), "result": F.col("o_orderstatus")}
    at = scratch(spark, "calls")
    callsource.write_folder(_orders(spark, sf_dir).select(*[c.alias(n) for n, c in {**void, **own}.items()]), at)
    callsource.register(spark)
    return spark.read.format("calls").option("path", at).load()


def _found(more: str = "") -> str:
    """Records with their place in, and whether full, the search of a day and what is asked besides."""
    by = f"PARTITION BY o_orderdate::DATE{more}"
    return f"""(SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER ({by} ORDER BY id) AS n, count(*) OVER ({by}) >= {rules.API_LIMIT} AS truncated
FROM (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS id, o_custkey % 7 AS agent_id, o_custkey AS flight_request_id, o_orderdate FROM orders WHERE o_orderdate IS NOT NULL)) WHERE n <= {rules.API_LIMIT}"""


@query("range_split_scan", f"SELECT id, agent_id, day, flight_request_id, truncated FROM {_found()}")
def range_split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders through searches that give at most so many records: each task halves its range of days."""
    return _service(spark, sf_dir).select("id", "agent_id", F.col("day").cast("string").alias("day"), "flight_request_id", "truncated")


@query(
    "call_source_search",
    f"SELECT id, agent_id, day, truncated FROM {_found(', agent_id')} AND o_orderdate::DATE >= DATE '1993-02-10' AND o_orderdate::DATE < DATE '1997-11-03' AND agent_id IN (2, 5) AND flight_request_id > 40",
)
def call_source_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and agents go into the searches; what the service cannot ask for is filtered after."""
    found = _service(spark, sf_dir).where("day >= DATE '1993-02-10' AND day < DATE '1997-11-03' AND agent_id IN (2, 5) AND flight_request_id > 40")
    return found.select("id", "agent_id", F.col("day").cast("string").alias("day"), "truncated")
