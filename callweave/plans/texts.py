"""Queries on text: cleaning, guards, tokens, keys and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, rules, text
from ..functions.numbers import exact_round_sql as rnd
from ..operators import truncate
from . import base
from .base import pick, pick_sql, query

_N = r"len(regexp_extract_all(text, '\S+'))"
_TEXTS = ["um, so we\nuh\nthen  Hmm,  fine", "  a   b \n\n\n c ", "Umbrella errors ah", "er\n", "plain"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents")


# RE2 knows ASCII word boundaries alone, so the SQL splits a text into runs of word characters and others
_WORD, _BLANK = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}", r"\t-\r\p{Z}\x{85}"
_FILLER = "lower({}) IN (" + ", ".join(f"'{x}'" for x in rules.FILLERS) + ")"


@query(
    "filler_removal",
    f"""SELECT doc_id, array_to_string(list_transform(t, lambda x, i: CASE WHEN {_FILLER.format('x')} THEN '' WHEN i > 1 AND {_FILLER.format('t[i - 1]')} THEN regexp_replace(x, '^,?[{_BLANK}]*', '') ELSE x END), '') AS cleaned
FROM (SELECT doc_id, regexp_extract_all({pick_sql(_TEXTS, 'doc_id')} || text, '[{_WORD}]+|[^{_WORD}]+') AS t FROM documents)""",
)
def filler_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.remove_fillers(F.concat(pick(_TEXTS, F.col("doc_id")), "text")).alias("cleaned"))


@query("whitespace_clean", f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split({pick_sql(_TEXTS, 'doc_id')} || text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '  +', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS cleaned FROM documents")
def whitespace_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.clean_whitespace(F.concat(pick(_TEXTS, F.col("doc_id")), "text")).alias("cleaned"))


@query("too_short_guard", f"SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 200 OR {_N} < 50 AS too_short FROM documents")
def too_short_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.too_short(F.col("text")).alias("too_short"))


@query("input_guard", "SELECT doc_id, CASE WHEN t IS NULL OR NOT regexp_matches(t, '\\S') THEN 'empty' WHEN contains(t, chr(0)) THEN 'nul_bytes' WHEN length(t) > 5000 THEN 'too_long' END AS error FROM (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN ' ' || chr(10) || chr(9) WHEN 1 THEN text || chr(0) ELSE text END AS t FROM documents)")
def input_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 7
    sent = F.when(kind == 0, " \n\t").when(kind == 1, F.concat("text", F.lit("\x00"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", text.input_error(sent, 5000).alias("error"))


@query(
    "token_estimate_cost",
    f"WITH t AS (SELECT doc_id, CAST(floor({_N} * 1.8::DOUBLE) AS INT) AS token_count FROM documents) SELECT doc_id, token_count, token_count > 500 AS needs_truncation, greatest(0, token_count - 500) AS excess_tokens, {rnd('(token_count / 1000000 * 2.0::DOUBLE + 1500 / 1000000 * 6.0::DOUBLE)', 4)} AS estimated_cost_usd FROM t",
)
def token_estimate_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.token_analysis(F.col("text"), 500, 2.0, 6.0).alias("a")).select("doc_id", "a.*")


@query("llm_cost", f"SELECT o_orderkey, {rnd('(o_orderkey * 13 % 9000 / 1000000 * 2.5::DOUBLE + o_orderkey * 7 % 1500 / 1000000 * 10.0::DOUBLE)', 6)} AS cost_usd FROM orders")
def llm_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return base.table(spark, sf_dir, "orders").select("o_orderkey", numbers.cost_usd(k * 13 % 9000, k * 7 % 1500, 2.5, 10.0).alias("cost_usd"))


@query("exact_rounding", f"SELECT event_id, {rnd('(value - 20)', 1)} AS one, {rnd('(value / 8)', 2)} AS two, {rnd('(value * 2)', 0)} AS none FROM events")
def exact_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return base.table(spark, sf_dir, "events").select("event_id", numbers.exact_round(v - 20, 1).alias("one"), numbers.exact_round(v / 8, 2).alias("two"), numbers.exact_round(v * 2, 0).alias("none"))


_COST = r"CAST(floor(len(regexp_extract_all(x, '\S+')) * 1.8::DOUBLE) AS INT)"


_MARK = rules.CUT_MARK.replace("\n", "' || chr(10) || '")
_LINES = "array_to_string({}, chr(10))"


@query(
    "truncate_middle_out",
    f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_replace(text, '[.,] ', chr(10), 'g'), '') AS x FROM documents),
t AS (SELECT doc_id, x, {_COST} AS tokens, string_split(x, chr(10)) AS l FROM d),
l AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM t WHERE tokens > 600),
c AS (SELECT doc_id, i, {_COST} AS cost FROM l),
s AS (SELECT doc_id, sum(cost) OVER (PARTITION BY doc_id ORDER BY i) AS up, sum(cost) OVER (PARTITION BY doc_id ORDER BY i DESC) AS down FROM c),
e AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE up <= 174) AS head, count(*) FILTER (WHERE down <= 176) AS tail FROM s GROUP BY doc_id),
g AS (SELECT *, greatest(0, total - tail - head) AS m, greatest(0, total - tail - head) // 2 AS mid FROM e),
u AS (SELECT doc_id, cost, i - head - 1 AS pos, abs(i - head - 1 - mid) AS round, row_number() OVER (PARTITION BY doc_id ORDER BY abs(i - head - 1 - mid), i DESC) AS v FROM c JOIN g USING (doc_id) WHERE i > head AND i <= head + m),
v AS MATERIALIZED (SELECT *, min(cost) OVER (PARTITION BY doc_id ORDER BY v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least FROM u),
r AS (SELECT doc_id, 0::BIGINT AS v, 0::BIGINT AS sum, 0::BIGINT AS round, false AS done, []::BIGINT[] AS kept FROM g
  UNION ALL SELECT doc_id, n, CASE WHEN take THEN sum + cost ELSE sum END, round, done, CASE WHEN take THEN list_append(kept, pos) ELSE kept END
  FROM (SELECT *, NOT done AND sum + cost <= 232 AS take FROM (
    SELECT r.doc_id, v.v AS n, r.sum, v.cost, v.round, v.pos, r.kept, r.done OR (v.round > r.round AND r.sum >= 232) AS done FROM r JOIN v ON v.doc_id = r.doc_id AND v.v = r.v + 1 AND r.sum + v.least <= 232))),
k AS (SELECT doc_id, list_sort(arg_max(kept, v)) AS kept FROM r GROUP BY doc_id),
n AS (SELECT t.doc_id, tokens, g.doc_id IS NOT NULL AS truncated, len(l) AS total_lines, coalesce(head + len(kept) + tail, len(l)) AS kept_lines,
    CASE WHEN g.doc_id IS NULL THEN x ELSE {_LINES.format('l[:head]')} || '{_MARK}' || CASE WHEN len(kept) > 0 THEN {_LINES.format('list_transform(kept, lambda a: l[head + a + 1])')} || '{_MARK}' ELSE '' END || {_LINES.format('l[total - tail + 1:]')} END AS text
  FROM t LEFT JOIN g ON g.doc_id = t.doc_id LEFT JOIN k ON k.doc_id = t.doc_id),
f AS (SELECT *, {_COST.replace('(x,', '(text,')} AS final FROM n)
SELECT doc_id, text, truncated, tokens AS original_tokens, final AS final_tokens, tokens - final AS removed_tokens, CASE WHEN truncated THEN {rnd('((tokens - final) / tokens * 100)', 1)} ELSE 0.0::DOUBLE END AS removed_percentage, kept_lines, total_lines FROM f""",
)
def truncate_middle_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = truncate.truncate(_docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"[.,] ", "\n").alias("transcript")), 600)
    return out.select("doc_id", "cut.*")


@query(
    "truncate_start_end",
    f"""WITH l AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '[.,] ', chr(10), 'g'), chr(10)) AS t FROM documents)),
s AS (SELECT doc_id, sum({_COST}) OVER (PARTITION BY doc_id ORDER BY i) AS up, sum({_COST}) OVER (PARTITION BY doc_id ORDER BY i DESC) AS down FROM l)
SELECT doc_id, count(*) FILTER (WHERE up <= 174) AS head_lines, count(*) FILTER (WHERE down <= 176) AS tail_lines FROM s GROUP BY doc_id""",
)
def truncate_start_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = F.transform(F.split(F.regexp_replace("text", r"[.,] ", "\n"), "\n"), text.token_estimate)
    return _docs(spark, sf_dir).select("doc_id", truncate.lines_within(costs, 174).cast("long").alias("head_lines"), truncate.lines_within(F.reverse(costs), 176).cast("long").alias("tail_lines"))


_SAID = ["good morning", "It's me again, hello", "we spoke yesterday about it", "nothing new", "As promised, the offer"]
_STATUS = ["new", "Follow-up needed", None, "closed", "callback set", "", "open"]
_RESULT = ["answered", "Callback", None, "voicemail", "followup", "lost", "won", "none", "busy", "no answer", "x"]
_FILES = ["a.mp3", "anna_2nd_call.mp3", "b.mp3", "Second.mp3", "c.mp3", "d.mp3"]


@query(
    "call_type_cascade",
    f"""SELECT doc_id, CASE WHEN lower(coalesce({pick_sql(_RESULT, 'doc_id')}, '')) IN ('follow-up', 'followup', 'callback') OR regexp_matches(lower(coalesce({pick_sql(_STATUS, 'doc_id')}, '')), 'follow|callback') OR regexp_matches(lower({pick_sql(_FILES, 'doc_id')}), '2nd|second|follow')
  OR list_bool_or(list_transform([{", ".join("'" + s.replace("'", "''") + "'" for s in rules.FOLLOW_UP)}], lambda s: contains(lower(substring({pick_sql(_SAID, 'doc_id')} || text, 1, 1000)), s))) THEN 'Follow-up Call' ELSE 'First Call' END AS call_type FROM documents""",
)
def call_type_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    kind = text.call_type(pick(_RESULT, n), pick(_STATUS, n), pick(_FILES, n), F.concat(pick(_SAID, n), "text"))
    return _docs(spark, sf_dir).select("doc_id", kind.alias("call_type"))


_CALLS = ["Agent: hi, my name is anna\nClient: my name is Bob\nAgent: this is CARL from sales", "Agent: I'm calling from x, my name is here", "agent: im Eve with us\nAgent: my name is eve", "Client: hello", "Agent: this is Tom calling. My name is Tim"]
_INTRO = [f"regexp_extract(x, '(?i){p}', 1)".replace("I'?m", "I''?m") for p in rules.NAME_INTRO]
_NO_NAMES = ", ".join(f"'{n}'" for n in rules.NO_NAMES)


@query(
    "agent_names_ordered_distinct",
    f"""WITH l AS (SELECT doc_id, list_filter(string_split({pick_sql(_CALLS, 'doc_id')} || chr(10) || text, chr(10)), lambda x: starts_with(lower(x), 'agent:')) AS l FROM documents),
n AS (SELECT doc_id, list_filter(flatten(list_transform(l, lambda x: [{", ".join(f"lower({i})" for i in _INTRO)}])), lambda n: n <> '' AND n NOT IN ({_NO_NAMES}) AND NOT (ends_with(n, 'ing') AND length(n) > 3)) AS n FROM l)
SELECT doc_id, array_to_string(list_transform(list_filter(n, lambda x, i: list_position(n, x) = i), lambda x: upper(x[1]) || x[2:]), ',') AS names FROM n""",
)
def agent_names_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.agent_names(F.concat(pick(_CALLS, F.col("doc_id")), F.lit("\n"), "text")), ",").alias("names"))


_PATHS = ["/tmp/John Doe_2nd call.mp3", "plain.wav", "dir.d/no_suffix", "__a--b__.tar.gz", "x y  z.MP3", ".hidden"]


@query(
    "safe_filename",
    f"""WITH n AS (SELECT part_.doc_id, regexp_extract(p, '[^/]*$') AS name FROM (SELECT doc_id, {pick_sql(_PATHS, 'doc_id')} AS p FROM documents) part_),
s AS (SELECT *, CASE WHEN regexp_matches(name, '^\\.[^.]*$') THEN '' ELSE regexp_extract(name, '(\\.[^.]+)$', 1) END AS suffix FROM n)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(name[:length(name) - length(suffix)], '[^\\w\\-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') || '_' || substring(sha256(name), 1, 6) || suffix AS safe FROM s""",
)
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.safe_filename(pick(_PATHS, F.col("doc_id"))).alias("safe"))


@query("cache_key_sha256", "SELECT doc_id, sha256('model-x|First Call|' || (doc_id % 40) || '|' || substring(sha256(lang), 1, 16) || '|' || substring(sha256(source), 1, 16) || '|0.1|' || text) AS key FROM documents")
def cache_key_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    return _docs(spark, sf_dir).select("doc_id", text.llm_cache_key(F.col("text"), F.lit("First Call"), F.col("doc_id") % 40, "model-x", part("lang"), part("source")).alias("key"))


@query("stt_key_sha256", "SELECT doc_id, sha256(text || '|stt-x|True|2|None') AS key FROM documents")
def stt_key_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.stt_cache_key(F.col("text").cast("binary"), "stt-x", True, 2, None).alias("key"))


@query("prompt_render", "SELECT doc_id, 'Call type: First Call' || chr(10) || 'Lines: {lines} {' || replace(replace(text || '{x}', '{', '{{'), '}', '}}') || '} n=' || (doc_id % 9) AS prompt FROM documents")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = text.render("Call type: {kind}\nLines: {lines} {{{transcript}}} n={n}", {"kind": F.lit("First Call"), "transcript": F.concat("text", F.lit("{x}")), "n": F.col("doc_id") % 9})
    return _docs(spark, sf_dir).select("doc_id", made.alias("prompt"))


_CODES = [401, 402, 429, 429, 500, 503, None, 404, None, 400]
_MESSAGES = ["denied", "You can only afford 3 tokens", "Quota exceeded", "slow down", "boom", "Model not found", "invalid API key", "the model x does not exist", "requires more credits", "?", "timeout"]


@query(
    "error_classification",
    f"""WITH e AS (SELECT event_id, {pick_sql(_MESSAGES, 'event_id')} AS m, ([401, 402, 429, 429, 500, 503, NULL, 404, NULL, 400])[event_id % 10 + 1] AS s FROM events)
SELECT event_id, CASE WHEN s = 401 OR regexp_matches(lower(m), 'authentication|invalid api key') THEN 'invalid_config' WHEN s = 402 OR regexp_matches(lower(m), 'can only afford|requires more credits') THEN 'quota_exhausted'
  WHEN s = 429 THEN CASE WHEN regexp_matches(lower(m), 'quota|billing|exceeded') THEN 'quota_exhausted' ELSE 'rate_limit' END WHEN s >= 500 THEN 'server_error'
  WHEN contains(lower(m), 'model') AND regexp_matches(lower(m), 'not found|does not exist|not a valid') THEN 'invalid_config' ELSE 'unknown' END AS kind FROM e""",
)
def error_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(c).cast("int") for c in _CODES]), (n % 10 + 1).cast("int"))
    return base.table(spark, sf_dir, "events").select("event_id", text.error_class(status, pick(_MESSAGES, n)).alias("kind"))


_SPELLED = ["D as in Denver, A as in Apple, N as in Nancy, Y for Yankee", "no spelling here", "A for Ann, B for Bob"]


@query("spelled_pattern", f"SELECT doc_id, regexp_matches(text || ' ' || {pick_sql(_SPELLED, 'doc_id')}, '(?i){rules.SPELLED}') AS spelled FROM documents")
def spelled_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.spelled_out(F.concat("text", F.lit(" "), pick(_SPELLED, F.col("doc_id")))).alias("spelled"))


_HEADS = ["49443304", "FFFB9000", "52494646", "664C6143", "4F676753", "00000000", "FFF30102"]


@query("magic_number_format", f"SELECT doc_id, CASE {' '.join(f"WHEN starts_with(h, '{magic}') THEN '{name}'" for magic, name in rules.MAGIC.items())} END AS format FROM (SELECT doc_id, ({pick_sql(_HEADS, 'doc_id')} || hex(encode(text)))[:8] AS h FROM documents)")
def magic_number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.unhex(pick(_HEADS, F.col("doc_id"))), F.col("text").cast("binary"))
    return _docs(spark, sf_dir).select("doc_id", text.audio_format(content).alias("format"))


@query(
    "edge_trim_decision",
    f"""WITH d AS (SELECT o_orderkey, o_orderkey * 31 % 60000 + 1000 AS n, o_orderkey * 7 % 900 AS a, o_orderkey % 11 = 0 AS silent FROM orders), e AS (SELECT *, greatest(0, a - 500) AS s, least(n, n - o_orderkey * 13 % 4000 + 500) AS z FROM d),
f AS (SELECT *, {rnd('((1 - (z - s) / greatest(1, n)) * 100)', 1)} AS pct FROM e)
SELECT o_orderkey, CASE WHEN NOT silent THEN s END AS start_ms, CASE WHEN NOT silent THEN z END AS end_ms, CASE WHEN silent THEN 100.0::DOUBLE ELSE pct END AS savings_pct, CASE WHEN silent THEN 'all_silence' WHEN pct < 5 THEN 'no_change' ELSE 'preprocessed' END AS action FROM f""",
)
def edge_trim_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n, silent = k * 31 % 60000 + 1000, k % 11 == 0
    return base.table(spark, sf_dir, "orders").select("o_orderkey", text.edge_trim(n, F.when(~silent, k * 7 % 900), F.when(~silent, n - k * 13 % 4000)).alias("t")).select("o_orderkey", "t.*")


@query("stt_price", f"SELECT o_orderkey, CAST(floor(o_totalprice / 1000 * 280) AS INT) AS credits, {rnd('(o_totalprice / 1000 * 0.005::DOUBLE)', 4)} AS cost_usd FROM orders")
def stt_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.col("o_totalprice") / 1000
    return base.table(spark, sf_dir, "orders").select("o_orderkey", numbers.stt_credits(minutes).alias("credits"), numbers.stt_cost(minutes).alias("cost_usd"))


_DATES = ["2024-01-05", "2031-01-01", "2024-13-01", "05.01.2024", "2023-02-29", "2024-02-29", "", "1999-9-9"]


@query("date_guard", f"SELECT doc_id, coalesce(regexp_full_match(d, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') AND try_strptime(d, '%Y-%m-%d')::DATE <= DATE '2026-01-01', false) AS valid FROM (SELECT doc_id, {pick_sql(_DATES, 'doc_id')} AS d FROM documents)")
def date_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.valid_date(pick(_DATES, F.col("doc_id")), F.lit("2026-01-01").cast("date")).alias("valid"))
