"""What the registered queries share: registration, stand-in inputs and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers find this package even if the driver runs in another folder
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A small generic set of criteria: key, category, weight, applicability, description, ordinal.
CRITERIA = [
    ("greets", "opening", 0.9, "both", "Greets the client", 1),
    ("states_reason", "opening", 0.5, "first_only", "Says why the call is made", 2),
    ("recalls_last_call", "opening", 1.1, "second_only", "Refers to the call before", 3),
    ("asks_needs", "discovery", 1.5, "first_only", "Asks what the client needs", 4),
    ("asks_budget", "discovery", 1.2, "first_only", "Asks for the budget", 5),
    ("presents_options", "offer", 1.3, "second_only", "Presents several options", 6),
    ("handles_doubts", "offer", 1.0, "second_only", "Answers doubts", 7),
    ("sums_up", "closing", 0.7, "both", "Sums up what was agreed", 8),
    ("next_step", "closing", 1.4, "both", "Agrees on the next step", 9),
    ("stays_polite", "manner", 0.6, "both", "Stays polite throughout", 10),
]
CATEGORIES = sorted({c[1] for c in CRITERIA})
CRITERIA_SQL = "(VALUES " + ", ".join(f"('{k}', '{c}', {w}::DOUBLE, '{a}', '{d}', {o})" for k, c, w, a, d, o in CRITERIA) + ") AS c(key, category, weight, applicability, description, ordinal)"


def criteria(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CRITERIA, "key string, category string, weight double, applicability string, description string, ordinal int")


def pick(options: list[str | None], n: Column) -> Column:
    """options[n modulo their number]."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(n, F.lit(len(options))) + 1).cast("int"))


def pick_sql(options: list[str | None], n: str) -> str:
    values = ", ".join("NULL" if o is None else "'" + o.replace("'", "''") + "'" for o in options)
    return f"([{values}])[(({n}) % {len(options)}) + 1]"


VERDICTS = ["YES", "PARTIAL", "NO", "N/A"]


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, key, score): a fixed verdict on each conversation and criterion, one key unknown."""
    keys = F.array(*[F.struct(F.lit(c[0]).alias("key"), F.lit(c[5]).alias("ordinal")) for c in CRITERIA], F.struct(F.lit("old_key").alias("key"), F.lit(11).alias("ordinal")))
    calls = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id")).distinct()
    rows = calls.select("call_id", F.explode(keys).alias("k"))
    return rows.select("call_id", "k.key", pick(VERDICTS, F.col("call_id") * 7 + F.col("k.ordinal") * 3).alias("score"))


VERDICTS_SQL = f"""SELECT v.call_id, v.key, v.score, coalesce(c.category, 'unknown') AS category, coalesce(c.weight, 1.0) AS weight
FROM (SELECT d.conv_id AS call_id, k.key, {pick_sql(VERDICTS, "d.conv_id * 7 + k.ordinal * 3")} AS score
      FROM (SELECT DISTINCT conv_id FROM conversations) d,
           (SELECT key, ordinal FROM {CRITERIA_SQL} UNION ALL SELECT 'old_key', 11) k) v
LEFT JOIN {CRITERIA_SQL} ON v.key = c.key"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, line_no, line): conversations as labelled lines, in order."""
    role = F.when(F.col("role") == "assistant", "Agent").when(F.col("role") == "user", "Client").otherwise("System")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), "turn", F.posexplode(F.split(F.concat(role, F.lit(": "), F.coalesce("text", F.lit(""))), "\n")).alias("i", "line"))
    return rows.select("call_id", (F.col("turn") * 100_000 + F.col("i")).alias("line_no"), "line")


LINES_SQL = """SELECT conv_id AS call_id, turn * 100000 + generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line
FROM (SELECT conv_id, turn, string_split(CASE role WHEN 'assistant' THEN 'Agent' WHEN 'user' THEN 'Client' ELSE 'System' END || ': ' || coalesce(text, ''), chr(10)) AS l FROM conversations)"""

SPEAKERS = ["speaker_0", "speaker_1", "speaker_0", "speaker_2", None, "speaker_1", "speaker_3"]
WORDS = ["well", "let me check", "thanks", "one moment", "sure", "yes", "no", "fine", "hold on", "right", "good"]


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, pos, text, speaker, type, start): events of a user as the words of a call."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "spacing").when(F.col("event_type") == "click", "punctuation").otherwise("word")
    clock = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())  # ts has no zone
    timed = F.when(F.col("event_id") % 13 != 0, F.unix_micros(clock) / 1e9)
    return e.select(F.col("user_id").alias("call_id"), F.col("event_id").alias("pos"), pick(WORDS, F.col("event_id")).alias("text"), pick(SPEAKERS, F.col("event_id") * 5 + F.col("user_id")).alias("speaker"), kind.alias("type"), timed.alias("start"))


WORDS_SQL = f"""SELECT user_id AS call_id, event_id AS pos, {pick_sql(WORDS, "event_id")} AS text, {pick_sql(SPEAKERS, "event_id * 5 + user_id")} AS speaker,
  CASE event_type WHEN 'view' THEN 'spacing' WHEN 'click' THEN 'punctuation' ELSE 'word' END AS type,
  CASE WHEN event_id % 13 <> 0 THEN epoch_us(ts) / 1e9 END AS start FROM events"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, seq, kind, cost): events of a user as the calls of a run."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("value").alias("cost"))


RUNS_SQL = "SELECT user_id AS run_id, event_id AS seq, event_type AS kind, value AS cost FROM events"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, overall_score, cost_usd, tokens_in, tokens_out, provider_used, word_count): orders as results."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_custkey") % 5).alias("run_id"), (F.col("o_orderkey") * 37 % 1001 / 10).alias("overall_score"), (F.col("o_totalprice") / 1e6).alias("cost_usd"),
        (F.col("o_orderkey") * 13 % 9000).alias("tokens_in"), (F.col("o_orderkey") * 7 % 1500).alias("tokens_out"), F.col("o_orderpriority").alias("provider_used"), (F.col("o_custkey") * 3 % 700).alias("word_count"),
    )


RESULTS_SQL = """SELECT o_custkey % 5 AS run_id, o_orderkey * 37 % 1001 / 10.0::DOUBLE AS overall_score, o_totalprice / 1e6 AS cost_usd, o_orderkey * 13 % 9000 AS tokens_in,
  o_orderkey * 7 % 1500 AS tokens_out, o_orderpriority AS provider_used, o_custkey * 3 % 700 AS word_count FROM orders"""
