"""Queries on files, transcripts and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio, numbers, text
from ..functions.numbers import exact_round_sql as rnd
from ..operators import calls, evaluate, report, turns, verdicts
from ..sources import readers, stores, writers
from ..sources.shared import scratch
from . import base
from .base import RESULTS_SQL, RUNS_SQL, query


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "orders")


@query("metadata_by_file", "SELECT o_orderkey || '.mp3' AS filename, 'inbound' AS direction, 'A' || o_custkey AS agent_name, o_orderpriority AS client_name, o_orderstatus AS result, o_orderstatus AS flight_request_status, o_orderkey AS call_id FROM orders WHERE o_orderstatus <> 'P'")
def metadata_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("/data/recordings/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".mp3")))
    records = _orders(spark, sf_dir).select(
        path.alias("local_audio_path"), F.lit("inbound").alias("direction"), F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("agent_name"), F.col("o_orderpriority").alias("client_name"),
        F.col("o_orderstatus").alias("result"), F.col("o_orderstatus").alias("flight_request_status"), F.col("o_orderkey").alias("id"),
    )
    return calls.metadata(records)


@query("short_audio_guard", f"SELECT event_id, {rnd('(value * 1000 / 60000)', 2)} AS minutes, {rnd('(value * 100000 / 1048576)', 2)} AS megabytes, CASE WHEN value < 5 THEN 'skipped_short' ELSE 'pending' END AS status FROM events")
def short_audio_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return base.table(spark, sf_dir, "events").select("event_id", numbers.minutes_of(v * 1000).alias("minutes"), numbers.megabytes(v * 100000).alias("megabytes"), text.stt_status(v).alias("status"))


#: The recordings of audio_silence are a document's bytes as samples, one a millisecond: spaces and capitals are loud, long words are pauses.
_PAUSE_MS, _PAUSE_DB = 12, -12.5


@query(
    "audio_silence",
    f"""WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: (('0x' || h)::INT - 128) * 256) AS s FROM documents),
x AS (SELECT doc_id, len(s) AS ms, unnest(s)::BIGINT AS v, generate_subscripts(s, 1) - 1 AS i FROM b),
e AS (SELECT doc_id, ms, i, sum(v * v) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {_PAUSE_MS - 1} FOLLOWING) AS e FROM x),
q AS (SELECT doc_id, ms, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {_PAUSE_MS} THEN 0 ELSE 1 END AS begins FROM e WHERE i + {_PAUSE_MS} <= ms AND e < {_PAUSE_MS * audio.quiet_limit(_PAUSE_DB)}),
g AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM q),
p AS (SELECT doc_id, min(i) AS a, max(i) + {_PAUSE_MS} AS z FROM g GROUP BY doc_id, island),
t AS (SELECT doc_id, count(*) AS n, sum(z - a) AS quiet, arg_min(z, a) FILTER (WHERE a = 0) AS head, min(a) AS first_a, max(z) AS last_z, arg_max(a, z) AS last_a FROM p GROUP BY doc_id),
d AS (SELECT b.doc_id, len(s) AS ms, n, quiet, head, last_z, last_a FROM b LEFT JOIN t ON b.doc_id = t.doc_id),
r AS (SELECT doc_id, ms, CASE WHEN ms = 0 THEN 0 ELSE coalesce(n, 0) + 1 - (head IS NOT NULL)::INT - (coalesce(last_z, -1) = ms)::INT END AS n_ranges, ms - coalesce(quiet, 0) AS sounding_ms, coalesce(head, 0) AS first_ms, CASE WHEN last_z = ms THEN last_a ELSE ms END AS last_ms FROM d),
c AS (SELECT *, n_ranges = 0 AS silent, greatest(0, first_ms - 3) AS s, least(ms, last_ms + 3) AS z FROM r),
f AS (SELECT *, {rnd('((1 - (z - s) / greatest(1, ms)) * 100)', 1)} AS pct FROM c)
SELECT doc_id, ms AS duration_ms, {rnd('(ms / 60000)', 2)} AS minutes, n_ranges, sounding_ms, CASE WHEN NOT silent THEN s END AS start_ms, CASE WHEN NOT silent THEN z END AS end_ms,
  CASE WHEN silent THEN 100.0::DOUBLE ELSE pct END AS savings_pct, CASE WHEN silent THEN 'all_silence' WHEN pct < 0.5 THEN 'no_change' ELSE 'preprocessed' END AS action FROM f""",
)
def audio_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sounds in recordings, and what is cut off their ends."""
    payload = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    files = base.table(spark, sf_dir, "documents").select("doc_id", audio.measured(audio.wave_bytes(payload, 1000), _PAUSE_MS, _PAUSE_DB).alias("m"))
    long = F.aggregate("m.sounding", F.lit(0).cast("long"), lambda n, x: n + x["end_ms"] - x["start_ms"])
    cut = files.select("doc_id", "m.duration_ms", audio.minutes(F.col("m")).alias("minutes"), F.size("m.sounding").alias("n_ranges"), long.alias("sounding_ms"), audio.trimmed(F.col("m"), 3, 0.5).alias("t"))
    return cut.select("doc_id", "duration_ms", "minutes", "n_ranges", "sounding_ms", "t.*")


@query(
    "audio_frames",
    f"""WITH d AS (SELECT doc_id, doc_id % 300 AS k, CASE WHEN doc_id % 300 > 0 THEN round(doc_id % 300 * 1152000 / 44100.0)::BIGINT END AS duration_ms FROM documents)
SELECT doc_id, CASE WHEN k > 0 THEN 'mp3' END AS format, duration_ms, {rnd('(duration_ms / 60000)', 2)} AS minutes, CASE WHEN duration_ms < 5000 THEN 'skipped_short' ELSE 'pending' END AS status FROM d""",
)
def audio_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of MP3 files, each of a tag that holds a document and of some frames."""
    tag, n = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    seven = F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(n.cast("long"), 7 * i).bitwiseAND(127)), 2, "0")) for i in (3, 2, 1, 0)])
    frames = F.unhex(F.repeat(F.lit((b"\xff\xfb\x90\x00" + bytes(413)).hex()), (F.col("doc_id") % 300).cast("int")))
    files = base.table(spark, sf_dir, "documents").select("doc_id", audio.measured(F.concat(F.lit(b"ID3\x04\x00\x00"), seven, tag, frames)).alias("m"))
    return files.select("doc_id", "m.format", "m.duration_ms", audio.minutes(F.col("m")).alias("minutes"), text.stt_status(F.col("m.duration_ms") / 1000).alias("status"))


@query("log_records", "SELECT doc_id::INT AS line, length(coalesce(text, ''))::INT AS n_chars, sha256(coalesce(text, '')) AS message_sha256, len(string_split(coalesce(text, ''), chr(10)))::INT AS n_lines FROM documents")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of a run log, of as many lines as they have, written and read again."""
    at = scratch(spark, "log")
    head = F.concat(F.lit("2024-05-01 10:00:00 [INFO] corpus ["), F.lit("docs.py:"), F.col("doc_id").cast("string"), F.lit("] "))
    base.table(spark, sf_dir, "documents").select(F.concat(head, F.coalesce("text", F.lit(""))).alias("value")).write.text(at)
    return readers.log_records(spark, at).select("line", F.length("message").alias("n_chars"), F.sha2("message", 256).alias("message_sha256"), "n_lines")


@query("export_columns", "SELECT doc_id, lang, n_chars FROM documents")
def export_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = {"raw_response": "text", "raw_text": "text", "system_prompt": "source"}
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", *[F.col(c).alias(name) for name, c in secret.items()])
    return verdicts.exportable(docs)


@query("clean_blank", "SELECT doc_id, CASE WHEN t IS NULL OR NOT regexp_matches(t, '\\S') THEN '' ELSE array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '  +', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)) END AS cleaned FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '  ' || chr(10) || chr(9) WHEN 1 THEN NULL ELSE text END AS t FROM documents)")
def clean_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 5
    said = F.when(kind == 0, "  \n\t").when(kind > 1, F.col("text"))
    return base.table(spark, sf_dir, "documents").select("doc_id", text.clean(said).alias("cleaned"))


@query(
    "export_document",
    f"SELECT provider_used, word_count, overall_score, cost_usd, calls, total_cost FROM ({RESULTS_SQL}), (SELECT count(*) AS calls, CAST(sum((o_totalprice / 1e6)::DECIMAL(18,6)) AS DOUBLE) AS total_cost FROM orders)",
)
def export_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results as one JSON document that tasks write in parts; its lines, read again in parallel."""
    at = scratch(spark, "document") + ".json"
    rows = base.results(spark, sf_dir).select("provider_used", "word_count", "overall_score", "cost_usd")
    writers.write_json_document(rows, at, "rule", "2024-05-01")
    lines = spark.read.text(at)
    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    each = lines.where(F.col("value").startswith('{"provider_used"')).select(F.from_json(F.rtrim(F.col("value"), F.lit(",")), fields).alias("r")).select("r.*")
    last = lines.where(F.col("value").startswith('], "metadata"')).select(F.from_json(F.concat(F.lit("{"), F.substring("value", 4, 1000)), "metadata struct<calls:bigint,cost_usd:double>").alias("m")).first()
    return each.select("*", F.lit(last.m.metadata.calls).alias("calls"), F.lit(last.m.metadata.cost_usd).alias("total_cost"))


@query("silence_stub", "SELECT conv_id AS call_id, 0.0::DOUBLE AS silence_pct, 0 AS longest_gap_ms, 0 AS num_gaps, 0 AS n_locations, true AS reconstructed FROM conversations GROUP BY conv_id")
def silence_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id")).distinct().withColumn("s", turns.no_silence())
    return rows.select("call_id", "s.silence_pct", "s.longest_gap_ms", "s.num_gaps", F.size("s.gap_locations").alias("n_locations"), F.col("s._reconstructed").alias("reconstructed"))


@query("length_score_pairs", f"SELECT word_count, overall_score, printf('%8s words | %6.1f/100', format('{{:,}}', word_count), overall_score) AS line FROM ({RESULTS_SQL}) WHERE overall_score > 0 AND word_count > 0")
def length_score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.length_score_pairs(base.results(spark, sf_dir))


@query("cache_columns", "SELECT o_orderkey AS key, o_orderdate AS cached_at, o_orderstatus AS overall_assessment, o_totalprice AS cost_usd FROM orders")
def cache_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("cached_at"), F.col("o_orderstatus").alias("overall_assessment"), F.col("o_totalprice").alias("cost_usd"), F.col("o_orderpriority").alias("raw_response"))
    return stores.allowed(rows, stores.LLM_COLUMNS)


@query(
    "published_results",
    f"""WITH r AS (SELECT *, kind = 'error' AS failed, kind IN ('purchase', 'signup') AS scored FROM ({RUNS_SQL})), i AS (SELECT *, sum(scored::INT) OVER (PARTITION BY run_id ORDER BY seq) AS island FROM r),
f AS (SELECT *, sum(failed::INT) OVER (PARTITION BY run_id, island ORDER BY seq) AS failures FROM i),
n AS (SELECT *, coalesce(max((failed AND failures >= 3)::INT) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM f)
SELECT run_id, seq AS call_id, kind, scored::INT AS yes_count FROM n WHERE gone = 0 AND NOT failed""",
)
def published_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    rows = base.runs(spark, sf_dir).select("run_id", F.col("seq").alias("call_id"), "kind", F.when(kind == "error", "server_error").alias("error"), kind.isin("purchase", "signup").cast("int").alias("yes_count"), F.lit(0).alias("partial_count"), F.lit(0).alias("no_count"))
    return evaluate.publish(rows).select("run_id", "call_id", "kind", "yes_count")
