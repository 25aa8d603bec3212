"""Queries on scoring, verdicts, talk shares and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import exact_round_sql as rnd
from ..operators import observed, report, scoring, verdicts
from ..sources.shared import scratch
from . import base
from .base import CATEGORIES, CRITERIA_SQL, LINES_SQL, RESULTS_SQL, VERDICTS_SQL, query

_COUNT = r"len(regexp_extract_all(line, '\S+'))"


@query(
    "listening_ratio",
    f"""WITH l AS ({LINES_SQL}), s AS (SELECT call_id, coalesce(sum({_COUNT}) FILTER (WHERE lower(line) LIKE 'agent:%'), 0) AS a, coalesce(sum({_COUNT}) FILTER (WHERE lower(line) LIKE 'client:%'), 0) AS c FROM l GROUP BY call_id)
SELECT call_id, {rnd("(CASE WHEN a + c > 0 THEN a / (a + c) * 100 ELSE 50.0 END)", 1)} AS agent_percentage, {rnd("(CASE WHEN a + c > 0 THEN c / (a + c) * 100 ELSE 50.0 END)", 1)} AS client_percentage,
  a + c AS total_words, CASE WHEN a + c = 0 THEN 'no_labeled_lines' WHEN a = 0 THEN 'agent_zero_words' WHEN c = 0 THEN 'client_zero_words' END AS ratio_warning FROM s""",
)
def listening_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.listening_ratio(base.lines(spark, sf_dir))


@query("turn_counts_by_role", "SELECT conv_id AS call_id, role, count(*) AS turns FROM conversations GROUP BY ALL")
def turn_counts_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("call_id"), "role").agg(F.count("*").alias("turns"))


_SCORED = f"""WITH v AS ({VERDICTS_SQL}), s AS (SELECT call_id,
  CAST(coalesce(sum(CASE WHEN score <> 'N/A' THEN weight::DECIMAL(10,4) * CASE score WHEN 'YES' THEN 2 WHEN 'PARTIAL' THEN 1 ELSE 0 END END), 0) AS DOUBLE) / 2 AS p,
  CAST(coalesce(sum(CASE WHEN score <> 'N/A' THEN weight::DECIMAL(10,4) END), 0) AS DOUBLE) AS w,
  count(*) FILTER (WHERE score = 'YES') AS y, count(*) FILTER (WHERE score = 'PARTIAL') AS h, count(*) FILTER (WHERE score = 'N/A') AS x, count(*) AS n FROM v GROUP BY call_id),
t AS (SELECT *, n - x AS scored, n - x - y - h AS no FROM s),
u AS (SELECT *, scored / greatest(1, n) AS cov, (y + no) / greatest(1, scored) AS agr FROM t),
scores AS (SELECT call_id, {rnd("(CASE WHEN w > 0 THEN p / w * 100 ELSE 0.0 END)", 1)} AS overall_score, {rnd("p", 2)} AS total_points, {rnd("w", 2)} AS total_weight,
  y AS yes_count, h AS partial_count, no AS no_count, x AS na_count, {rnd("cov", 3)} AS coverage, {rnd("agr", 3)} AS agreement,
  {rnd("(cov * 0.5::DOUBLE + agr * 0.3::DOUBLE + least(1.0::DOUBLE, scored / 10) * 0.2::DOUBLE)", 3)} AS confidence FROM u)"""
_CATEGORIES = f"""cats AS (SELECT call_id, category, {rnd("(CASE WHEN w > 0 THEN p / w * 100 ELSE 0.0 END)", 1)} AS category_score, n FROM (SELECT call_id, category,
  CAST(sum(weight::DECIMAL(10,4) * CASE score WHEN 'YES' THEN 2 WHEN 'PARTIAL' THEN 1 ELSE 0 END) AS DOUBLE) / 2 AS p, CAST(sum(weight::DECIMAL(10,4)) AS DOUBLE) AS w, count(*) AS n
  FROM v WHERE score <> 'N/A' GROUP BY ALL))"""


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.weighted(base.verdicts(spark, sf_dir), base.criteria(spark))


@query("score_overall", _SCORED + " SELECT * FROM scores")
def score_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_calls(_weighted(spark, sf_dir))


@query("score_by_category", f"{_SCORED}, {_CATEGORIES} SELECT * FROM cats")
def score_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_categories(_weighted(spark, sf_dir))


@query(
    "summary_pivot",
    f"{_SCORED}, {_CATEGORIES} SELECT scores.*, " + ", ".join(f"coalesce(max(category_score) FILTER (WHERE category = '{c}'), 0.0) AS {c}" for c in [*CATEGORIES, "unknown"]) + " FROM scores LEFT JOIN cats USING (call_id) GROUP BY ALL",
)
def summary_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _weighted(spark, sf_dir)
    return scoring.pivot_summary(scoring.score_calls(rows), scoring.score_categories(rows), [*CATEGORIES, "unknown"])


@query("details_default_weight", f"SELECT call_id, key, score, key || ' ' || call_id AS evidence, category, weight FROM ({VERDICTS_SQL})")
def details_default_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.verdicts(spark, sf_dir).select("call_id", "key", F.struct("score", F.concat("key", F.lit(" "), "call_id").alias("evidence")).alias("v"))
    evaluations = rows.groupBy("call_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("criteria"))
    return scoring.details(evaluations, base.criteria(spark)).select("call_id", "key", "score", "evidence", "category", "weight")


@query(
    "criteria_applicable_join",
    f"SELECT conv_id AS call_id, conv_id % 3 = 0 AS follow_up, c.key, c.category FROM (SELECT DISTINCT conv_id FROM conversations) d JOIN {CRITERIA_SQL} ON c.applicability = 'both' OR c.applicability = CASE WHEN conv_id % 3 = 0 THEN 'second_only' ELSE 'first_only' END",
)
def criteria_applicable_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = base.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id")).distinct().withColumn("follow_up", F.col("call_id") % 3 == 0)
    return scoring.applicable(calls, base.criteria(spark)).select("call_id", "follow_up", "key", "category")


_EVIDENCE = ["said [PHONE] twice", "nothing", "wrote to [EMAIL]", "card [CC_NUMBER]", None, "[phone] in lower case"]


@query("pii_tag_count", f"SELECT conv_id AS call_id, sum(CASE WHEN regexp_matches({base.pick_sql(_EVIDENCE, 'conv_id + o')}, '\\[(PHONE|EMAIL|SPELLED_PII|NATO_SPELLED|PNR|BOOKING_REF|CC_NUMBER|SSN)\\]') THEN 1 ELSE 0 END)::BIGINT AS affected FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest([0, 1, 2, 3]) AS o) GROUP BY ALL")
def pii_tag_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = base.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id")).distinct()
    entries = F.array(*[F.struct(F.lit(f"k{o}"), F.struct(F.lit("YES").alias("score"), base.pick(_EVIDENCE, F.col("call_id") + o).alias("evidence"))) for o in range(4)])
    return calls.select("call_id", verdicts.pii_affected(F.map_from_entries(entries)).cast("long").alias("affected"))


_RAW_SCORES = ["yes", "Partial", "NO", "n/a", "maybe", "", None]


@query("score_validation", f"SELECT o_orderkey, upper(s) AS score, coalesce(upper(s) NOT IN ('YES', 'PARTIAL', 'NO', 'N/A'), true) AS invalid FROM (SELECT o_orderkey, {base.pick_sql(_RAW_SCORES, 'o_orderkey')} AS s FROM orders)")
def score_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = base.pick(_RAW_SCORES, F.col("o_orderkey"))
    return base.table(spark, sf_dir, "orders").select("o_orderkey", F.upper(score).alias("score"), verdicts.invalid_score(score).alias("invalid"))


_GOOD = '{"criteria": {"a": {"score": "yes", "evidence": "%s"}, "b": {"score": "NO", "evidence": ""}}, "overall_assessment": "x", "strengths": [], "improvements": ["y"]}'
_ANSWERS = [_GOOD, f"Sure:\n```json\n{_GOOD}\n```", f"```\n{_GOOD}\n```", f"text {{not json}} then {_GOOD} and more", '{"criteria": {', "", _GOOD.replace("yes", "perhaps"), '{"criteria": {}}', "[1, 2]", _GOOD.replace('"b"', '"c"')]


@query(
    "json_extract_validate",
    f"""WITH a AS (SELECT doc_id, replace({base.pick_sql(_ANSWERS, 'doc_id')}, '%s', regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', ' ', 'g')) AS s FROM documents),
f AS (SELECT doc_id, s, list_filter([s, regexp_extract(s, '(?s)```json\\s*(.*?)\\s*```', 1), regexp_extract(s, '(?s)```\\s*(.*?)\\s*```', 1)], lambda x: x <> '' AND json_valid(x))[1] AS whole FROM a),
p AS (SELECT doc_id, s, unnest(list_filter(range(1, length(s) + 1), lambda i: s[i] = '{{')) AS p FROM f WHERE whole IS NULL),
q AS (SELECT doc_id, p, s, unnest(list_filter(range(p, length(s) + 1), lambda i: s[i] = '}}')) AS q FROM p),
o AS (SELECT doc_id, arg_min(s[p:q], p) AS part FROM q WHERE json_valid(s[p:q]) GROUP BY doc_id),
j AS (SELECT doc_id, CAST(coalesce(whole, part) AS JSON) AS j FROM f LEFT JOIN o USING (doc_id)),
k AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN j->'criteria' END AS c FROM j),
m AS (SELECT *, list_filter(['a', 'b'], lambda x: NOT list_contains(CASE WHEN json_type(c) = 'OBJECT' THEN json_keys(c) ELSE [] END, x)) AS missing FROM k),
e AS (SELECT *, CASE WHEN j IS NULL THEN 'no_json' WHEN json_type(j) <> 'OBJECT' THEN 'not_an_object'
    WHEN NOT list_has_all(json_keys(j), ['criteria', 'overall_assessment', 'strengths', 'improvements']) THEN 'missing_fields' WHEN json_type(c) <> 'OBJECT' THEN 'bad_criteria' WHEN len(missing) > 0 THEN 'missing_keys'
    WHEN NOT list_has_all(['YES', 'PARTIAL', 'NO', 'N/A'], list_transform(json_keys(c), lambda x: upper(coalesce(c->x->>'score', '')))) THEN 'invalid_scores' END AS error FROM m)
SELECT doc_id, error, len(missing) AS n_missing, CASE WHEN len(missing) > 0 THEN 'Missing criteria: ' || array_to_string(missing, ', ') END AS note, CASE WHEN error IS NULL THEN upper(c->'a'->>'score') END AS a_score, CASE WHEN error IS NULL THEN c->'a'->>'evidence' END AS evidence FROM e""",
)
def json_extract_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", " ")
    docs = base.table(spark, sf_dir, "documents").select("doc_id", F.replace(base.pick(_ANSWERS, F.col("doc_id")), F.lit("%s"), said).alias("answer"))
    first = F.col("evaluation.criteria")["a"]
    return verdicts.parse_answers(docs, ["a", "b"]).select("doc_id", "error", F.size("missing_keys").alias("n_missing"), verdicts.missing_note(F.col("missing_keys")).alias("note"), first["score"].alias("a_score"), first["evidence"].alias("evidence"))


@query(
    "run_summary",
    f"""SELECT run_id, count(*) AS calls, avg(overall_score) AS avg_score, max(overall_score) AS max_score, min(overall_score) AS min_score, CASE WHEN count(overall_score) > 1 THEN stddev_pop(overall_score) END AS score_stddev,
  CAST(sum(cost_usd::DECIMAL(18,6)) AS DOUBLE) AS llm_cost, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, string_agg(DISTINCT provider_used, ',' ORDER BY provider_used) AS providers,
  CAST(sum(cost_usd::DECIMAL(18,6)) AS DOUBLE) / 500.0 * 100 AS budget_used_pct, 500.0 - CAST(sum(cost_usd::DECIMAL(18,6)) AS DOUBLE) AS budget_left FROM ({RESULTS_SQL}) GROUP BY run_id""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.run_summary(base.results(spark, sf_dir), 500.0, ["run_id"])


@query("webhook_summary", f"SELECT {rnd('a', 1)} AS average_score, {rnd('c', 4)} AS total_cost, total_calls FROM (SELECT avg(overall_score) AS a, CAST(sum(cost_usd::DECIMAL(18,6)) AS DOUBLE) AS c, count(*) AS total_calls FROM ({RESULTS_SQL}))")
def webhook_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.webhook_summary(base.results(spark, sf_dir))


@query("cost_rollup", f"SELECT provider_used, run_id, count(*) AS calls, CAST(sum(cost_usd::DECIMAL(18,6)) AS DOUBLE) AS cost FROM ({RESULTS_SQL}) GROUP BY ROLLUP (provider_used, run_id)")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cost_rollup(base.results(spark, sf_dir))


@query(
    "length_score_corr",
    f"SELECT n, r, r * r AS r2, CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.7 THEN 'moderate' ELSE 'strong' END AS strength FROM (SELECT count(*) AS n, corr(word_count, overall_score) AS r FROM ({RESULTS_SQL}) WHERE overall_score > 0 AND word_count > 0) WHERE n >= 3",
)
def length_score_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.length_score(base.results(spark, sf_dir)).select("n", F.round("r", 9).alias("r"), F.round("r2", 9).alias("r2"), "strength")


base.SQL["length_score_corr"] = base.SQL["length_score_corr"].replace("SELECT n, r, r * r AS r2", "SELECT n, round(r, 9) AS r, round(r * r, 9) AS r2", 1)


@query(
    "prompt_criteria_text",
    """WITH c AS (SELECT p_brand AS brand, p_partkey AS ordinal, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, p_name AS key, p_type AS category, p_size / 10.0::DOUBLE AS weight, p_type || ' of size ' || p_size AS description FROM part)
SELECT brand, string_agg(i || '. **' || key || '** (Category: ' || category || ', Weight: ' || weight || ')' || chr(10) || '   ' || description || chr(10), chr(10) ORDER BY ordinal) AS text FROM c GROUP BY brand""",
)
def prompt_criteria_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt's list of criteria for each brand, whose parts are the criteria."""
    criteria = base.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("key"), F.col("p_type").alias("category"), (F.col("p_size") / 10).alias("weight"), F.concat("p_type", F.lit(" of size "), F.col("p_size").cast("string")).alias("description"),
    )
    return report.criteria_text(criteria, ["brand"])


@query("metrics_by_event", "SELECT event_type AS event, count(*) AS n FROM events GROUP BY ALL")
def metrics_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.events_by_kind(base.table(spark, sf_dir, "events").withColumnRenamed("event_type", "event"))


_KINDS = ["click", "purchase", "signup", "view"]


@query("metrics_observed", f"SELECT CASE WHEN event_type IN ({str(_KINDS)[1:-1]}) THEN event_type END AS event, count(*) AS n FROM events GROUP BY ALL")
def metrics_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind, observed while they are written; what is not among the kinds is counted together."""
    rows, seen = observed.observed(base.table(spark, sf_dir, "events").withColumnRenamed("event_type", "event"), _KINDS)
    rows.write.parquet(scratch(spark, "events"))
    return observed.totals(spark, seen, _KINDS)


@query(
    "export_summary",
    f"{_SCORED}, {_CATEGORIES}, w AS (SELECT scores.*, "
    + ", ".join(f"coalesce(max(category_score) FILTER (WHERE category = '{c}'), 0.0) AS {c}" for c in CATEGORIES)
    + " FROM scores LEFT JOIN cats USING (call_id) GROUP BY ALL) SELECT 'call_' || call_id || '.mp3' AS \"File\", 'First Call' AS \"Type\", overall_score AS \"Score\", confidence AS \"Confidence\", "
    + ", ".join(CATEGORIES)
    + ', yes_count AS "YES", partial_count AS "PARTIAL", no_count AS "NO", call_id / 1000 AS "Cost" FROM w',
)
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _weighted(spark, sf_dir)
    wide = scoring.pivot_summary(scoring.score_calls(rows), scoring.score_categories(rows), CATEGORIES)
    named = wide.withColumn("filename", F.concat(F.lit("call_"), "call_id", F.lit(".mp3"))).withColumn("call_type", F.lit("First Call")).withColumn("cost_usd", F.col("call_id") / 1000)
    return report.export_summary(named, CATEGORIES)


@query(
    "pipeline_warnings",
    "SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'TRUNCATED: ' || (doc_id % 50) || '.5% of transcript removed' END, CASE WHEN doc_id % 4 > 0 THEN 'PII_IN_EVIDENCE: ' || (doc_id % 4) || ' criteria affected' END, CASE WHEN doc_id % 2 = 0 THEN 'LOW_CONFIDENCE_SPEAKER: direction-based heuristic used' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM documents",
)
def pipeline_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pct = F.when(d % 3 == 0, F.concat((d % 50).cast("string"), F.lit(".5")).cast("double"))
    found = text.warnings(pct, d % 4, F.when(d % 2 == 0, "direction").otherwise("intro"))
    return base.table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, "; ").alias("warnings"))
