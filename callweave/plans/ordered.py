"""Queries on ordered state: turns, silence, roles, cut-offs and fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numbers import exact_round_sql as rnd
from ..operators import control, roles, turns
from ..streaming import metrics
from . import base
from .base import RUNS_SQL, WORDS_SQL, query

_GAPS = f"w AS ({WORDS_SQL}), t AS (SELECT *, lag(start) OVER (PARTITION BY call_id ORDER BY pos) AS from_s FROM w WHERE type = 'word' AND start IS NOT NULL)"
_MS = rnd("((start - from_s) * 1000)", 0)


@query("silence_gaps", f"WITH {_GAPS} SELECT call_id, pos, from_s, start AS to_s, (start - from_s) * 1000 AS gap_ms FROM t WHERE from_s IS NOT NULL")
def silence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.gaps(base.words(spark, sf_dir))


@query(
    "silence_stats",
    f"""WITH {_GAPS}, g AS (SELECT call_id, pos, start, CASE WHEN (start - from_s) * 1000 > 1000 THEN CAST({_MS} AS BIGINT) END AS ms FROM t),
s AS (SELECT call_id, coalesce(max(ms), 0) AS longest_gap_ms, count(*) FILTER (WHERE ms >= 30000) AS num_gaps_over_30s, coalesce(sum(ms), 0)::BIGINT AS total_silence_ms, count(ms) AS num_gaps, arg_max(start, pos) AS e FROM g GROUP BY call_id)
SELECT call_id, longest_gap_ms, num_gaps_over_30s, total_silence_ms, num_gaps, {rnd("(total_silence_ms / greatest(1.0::DOUBLE, CASE WHEN e > 0 THEN e * 1000 ELSE 0.0 END) * 100)", 1)} AS silence_pct FROM s""",
)
def silence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.silence_stats(base.words(spark, sf_dir)).drop("gap_locations")


@query(
    "top20_gaps",
    f"""WITH {_GAPS}, g AS (SELECT call_id, pos, {rnd("from_s", 1)} AS start_s, {rnd("start", 1)} AS end_s, CAST({_MS} AS BIGINT) AS duration_ms FROM t WHERE (start - from_s) * 1000 > 1000)
SELECT call_id, row_number() OVER o AS rank, start_s, end_s, duration_ms FROM g WINDOW o AS (PARTITION BY call_id ORDER BY duration_ms DESC, pos) QUALIFY row_number() OVER o <= 20""",
)
def top20_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns.silence_stats(base.words(spark, sf_dir))
    return found.select("call_id", F.posexplode("gap_locations").alias("i", "g")).select("call_id", (F.col("i") + 1).cast("long").alias("rank"), "g.start_s", "g.end_s", "g.duration_ms")


@query("words_per_speaker", f"SELECT call_id, speaker, count(*) AS n FROM ({WORDS_SQL}) WHERE type = 'word' AND speaker IS NOT NULL GROUP BY ALL")
def words_per_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.speaker_words(base.words(spark, sf_dir))


_MERGED = f"""w AS ({WORDS_SQL}),
c AS (SELECT call_id, speaker, count(*) FILTER (WHERE type = 'word') AS n, min(pos) AS first FROM w WHERE speaker IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY n DESC, first) AS rank, count(*) FILTER (WHERE n > 0) OVER (PARTITION BY call_id) AS many FROM c),
o AS (SELECT w.*, many, rank, CASE WHEN rank <= 2 THEN w.speaker END AS major FROM w LEFT JOIN r USING (call_id, speaker)),
l AS (SELECT *, last_value(major IGNORE NULLS) OVER (PARTITION BY call_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS last_major, first_value(major IGNORE NULLS) OVER (PARTITION BY call_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_major FROM o),
m AS (SELECT *, CASE WHEN speaker IS NULL OR many <= 2 OR major IS NOT NULL THEN speaker ELSE coalesce(first_value(last_major) OVER (PARTITION BY call_id, speaker ORDER BY pos), first_major) END AS effective FROM l)"""


@query("minor_speaker_merge", f"WITH {_MERGED} SELECT call_id, pos, speaker, effective FROM m")
def minor_speaker_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.merge_minor(base.words(spark, sf_dir), (F.col("type") == "word").cast("int")).select("call_id", "pos", "speaker", "effective")


@query(
    "diarised_lines",
    f"""WITH {_MERGED},
g AS (SELECT *, CASE WHEN type = 'word' AND start IS NOT NULL THEN start - last_value(CASE WHEN type = 'word' THEN start END IGNORE NULLS) OVER (PARTITION BY call_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS gap,
  last_value(effective IGNORE NULLS) OVER (PARTITION BY call_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cur, last_value(effective IGNORE NULLS) OVER (PARTITION BY call_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM m),
i AS (SELECT *, sum(CASE WHEN (effective IS NOT NULL AND effective IS DISTINCT FROM earlier) OR gap >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM g),
s AS (SELECT call_id, island, max(CASE WHEN gap >= 30 THEN gap END) AS gap, CASE WHEN max(cur) IS NULL THEN 'Speaker' ELSE 'Speaker ' || split_part(max(cur), '_', 2) END || ': ' || trim(string_agg(CASE WHEN type = 'spacing' THEN ' ' ELSE text END, '' ORDER BY pos)) AS line FROM i GROUP BY ALL),
h AS (SELECT *, coalesce(regexp_matches(lag(line) OVER (PARTITION BY call_id ORDER BY island), '(?i){rules.HOLD.replace("'", "''")}'), false) AS held FROM s),
p AS (SELECT call_id, island, 0 AS k, '[' || (floor(gap)::BIGINT // 60) || ':' || lpad((floor(gap)::BIGINT % 60)::VARCHAR, 2, '0') || ' silence' || CASE WHEN held THEN ' — hold' ELSE '' END || ']' AS line FROM h WHERE gap IS NOT NULL UNION ALL SELECT call_id, island, 1, line FROM h)
SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY island, k) AS line_no, line FROM p""",
)
def diarised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.build_lines(base.words(spark, sf_dir))


_ROLES = "(SELECT conv_id AS call_id, turn AS line_no, role AS speaker FROM conversations)"


def _speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("line_no"), F.col("role").alias("speaker"))


@query("first_second_speaker", f"WITH s AS (SELECT call_id, speaker, min(line_no) AS at_ FROM {_ROLES} GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY at_) AS n FROM s) SELECT call_id, max(speaker) FILTER (WHERE n = 1) AS first_speaker, max(speaker) FILTER (WHERE n = 2) AS second_speaker FROM o GROUP BY call_id")
def first_second_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.speaker_order(_speakers(spark, sf_dir))


@query("top2_speakers", f"WITH s AS (SELECT call_id, speaker, count(*) AS n, min(line_no) AS at_ FROM {_ROLES} GROUP BY ALL) SELECT call_id, speaker, n, row_number() OVER (PARTITION BY call_id ORDER BY n DESC, at_) AS rank FROM s QUALIFY rank <= 2")
def top2_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.top_speakers(_speakers(spark, sf_dir))


_SAYINGS = ["Hello?", "thank you for calling Northwind, how can I help", "my name is Ann", "I need a flight", "this call is being recorded", "fine", "who is this", "yes", "ok then"]
_LABELS = ["Speaker 0", "speaker 1", "Speaker 0", "Speaker 2"]

def _any(patterns: list[str]) -> str:
    return "regexp_matches(content, '(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "')"


_INTRO = rules.AGENT_INTRO + [rules.AGENT_INTRO_COMPANY.replace("{names}", "northwind|the company")]
_PICK = "arg_min({v}, line_no) FILTER (WHERE {c}) OVER (PARTITION BY call_id)"
_ROLE_SQL = f"""WITH r AS (SELECT conv_id AS call_id, turn AS line_no, lower({base.pick_sql(_LABELS, "turn * 3 + conv_id")}) AS speaker, {base.pick_sql(_SAYINGS, "conv_id * 5 + turn * 7")} AS content FROM conversations),
c AS (SELECT call_id, speaker, count(*) AS n, min(line_no) AS first FROM r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY n DESC, first) AS rank, count(*) OVER (PARTITION BY call_id) AS many FROM c),
o AS (SELECT *, max(CASE WHEN first = (SELECT min(first) FROM c c2 WHERE c2.call_id = k.call_id) THEN rank END) OVER (PARTITION BY call_id) AS opening FROM k),
j AS (SELECT r.*, many, CASE WHEN rank = 1 OR rank = greatest(2, opening) THEN speaker END AS major FROM r JOIN o USING (call_id, speaker)),
l AS (SELECT *, last_value(major IGNORE NULLS) OVER (PARTITION BY call_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS last_major, first_value(major IGNORE NULLS) OVER (PARTITION BY call_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_major FROM j),
m AS (SELECT *, CASE WHEN many <= 2 OR major IS NOT NULL THEN speaker ELSE coalesce(first_value(last_major) OVER (PARTITION BY call_id, speaker ORDER BY line_no), first_major) END AS effective,
  regexp_matches(lower(content), '{"|".join(rules.ANNOUNCEMENTS)}') AS announced, {_any(_INTRO)} AS intro, {_any(rules.INBOUND_AGENT)} AS inbound, {_any(rules.AGENT_BEHAVIOUR)} AS behaves, {_any(rules.CLIENT)} AS client FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY line_no) AS n, sum(CASE WHEN announced THEN 0 ELSE 1 END) OVER (PARTITION BY call_id ORDER BY line_no) AS spoken FROM m),
f AS (SELECT *, arg_min(speaker, line_no) OVER (PARTITION BY call_id) AS f1 FROM n),
g AS (SELECT *, {_PICK.format(v="speaker", c="speaker <> f1")} AS f2, {_PICK.format(v="effective", c="n <= 20 AND NOT announced AND contains(lower(content), 'northwind') AND (behaves OR inbound)")} AS company,
  coalesce({_PICK.format(v="effective", c="spoken <= 25 AND NOT announced AND intro")}, {_PICK.format(v="effective", c="spoken <= 25 AND NOT announced AND inbound")}) AS introduced, {_PICK.format(v="effective", c="n <= 25 AND client")} AS is_client FROM f),
h AS (SELECT *, CASE WHEN is_client IS NOT NULL THEN CASE WHEN f1 <> is_client THEN f1 ELSE f2 END END AS other FROM g),
i AS (SELECT *, CASE WHEN effective = coalesce(company, introduced, other, f2, f1) THEN 'Agent' ELSE 'Client' END AS role FROM h)
SELECT call_id, line_no, role || ': ' || content AS line, CASE WHEN company IS NOT NULL THEN 'company' WHEN introduced IS NOT NULL THEN 'intro' WHEN other IS NOT NULL THEN 'client_content' ELSE 'direction' END AS method,
  bool_or(role = 'Client' AND intro) OVER (PARTITION BY call_id) AS intro_on_client FROM i"""


@query("role_labelling", _ROLE_SQL)
def role_labelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("line_no"), F.concat(base.pick(_LABELS, F.col("turn") * 3 + F.col("conv_id")), F.lit(": "), base.pick(_SAYINGS, F.col("conv_id") * 5 + F.col("turn") * 7)).alias("line"))
    return roles.label_roles(c, companies=["Northwind"], company_patterns=["northwind"])


_FAILED, _RESET = "kind = 'error'", "kind = 'purchase'"


@query(
    "circuit_breaker_cutoff",
    f"""WITH r AS ({RUNS_SQL}), i AS (SELECT *, sum(CASE WHEN {_RESET} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq) AS island FROM r),
f AS (SELECT *, sum(CASE WHEN {_FAILED} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, island ORDER BY seq) AS failures, count(*) OVER (PARTITION BY run_id) - row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rest FROM i),
t AS (SELECT *, {_FAILED} AND failures >= 3 AS tripped FROM f), n AS (SELECT *, coalesce(sum(tripped::INT) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT run_id, seq, kind, cost, failures::BIGINT AS failures, tripped, CASE WHEN tripped THEN rest END AS remaining FROM n WHERE before = 0""",
)
def circuit_breaker_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.circuit_breaker(base.runs(spark, sf_dir), F.expr(_FAILED), F.expr(_RESET))


_SPENT = f"WITH s AS (SELECT *, CAST(sum(cost::DECIMAL(18,6)) OVER (PARTITION BY run_id ORDER BY seq) AS DOUBLE) AS spent FROM ({RUNS_SQL}))"


@query("budget_cutoff", f"{_SPENT} SELECT run_id, seq, kind, cost, spent + 12.5 AS spent, spent + 12.5 >= 800.0 AS warned FROM s WHERE spent + 12.5 < 1000")
def budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.budget_cutoff(base.runs(spark, sf_dir), "cost", 1000.0, F.lit(12.5))


@query("cost_warning_first_row", f"{_SPENT} SELECT run_id, seq, kind, cost, spent FROM s WHERE spent >= 500 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq) = 1")
def cost_warning_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.first_over(base.runs(spark, sf_dir), "cost", 500.0)


@query("quota_stop", f"SELECT run_id, seq, kind, cost FROM (SELECT *, coalesce(max((kind = 'signup')::INT) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM ({RUNS_SQL})) WHERE gone = 0")
def quota_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.stop_after(base.runs(spark, sf_dir), F.col("kind") == "signup")


_OUTCOMES = ["ok", "server_error", "ok", "rate_limit", "quota_exhausted", "ok", "unknown", "server_error", "ok", "ok", "server_error", "rate_limit", "ok"]
_PROVIDERS = ["alpha", "beta", "gamma"]


@query(
    "provider_fallback",
    f"""WITH a AS (SELECT user_id AS run_id, event_id AS call_seq, k AS rank, {base.pick_sql(_PROVIDERS, "k")} AS provider, {base.pick_sql(_OUTCOMES, "event_id * 3 + k * 5 + user_id")} AS outcome FROM events, (SELECT unnest([0, 1, 2]) AS k)),
g AS (SELECT *, coalesce(max((outcome IN ('quota_exhausted', 'invalid_config'))::INT) OVER (PARTITION BY run_id, provider ORDER BY call_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM a)
SELECT run_id, call_seq, arg_min(provider, rank) FILTER (WHERE gone = 0 AND outcome = 'ok') AS provider, count(*) FILTER (WHERE gone = 0) AS open_providers FROM g GROUP BY ALL""",
)
def provider_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(p).alias("provider")) for k, p in enumerate(_PROVIDERS)]))
    e = base.table(spark, sf_dir, "events").select("event_id", "user_id", ranks.alias("p"))
    attempts = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("call_seq"), "p.rank", "p.provider", base.pick(_OUTCOMES, F.col("event_id") * 3 + F.col("p.rank") * 5 + F.col("user_id")).alias("outcome"))
    return control.first_success(attempts)


@query("event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type AS event, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.event_counts(base.table(spark, sf_dir, "events").withColumnRenamed("event_type", "event"), "1 day")


@query(
    "event_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sessions(base.table(spark, sf_dir, "events"), "user_id", "6 hours")
