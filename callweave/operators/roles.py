"""From Speaker N: labels to Agent: and Client:.

Evidence is taken in order: a line that names the company and behaves like an agent; a
self-introduction, then an inbound greeting; a client's phrase, which makes the other
speaker the agent; else the second speaker, or the only one. Each is the first of the
first few lines of a call that meets a condition, a minimum over the call's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.window import WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from .turns import merge_minor

SCAN_COMPANY, SCAN_INTRO, SCAN_CLIENT = 20, 25, 25

_LABEL = r"(?iU)^(Speaker\s*\d+)\s*:\s*"

def _call() -> WindowSpec:
    return W.partitionBy("call_id")


def _upto() -> WindowSpec:
    return _call().orderBy("pos").rowsBetween(W.unboundedPreceding, 0)


def _contains_any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | text.contains(phrase.lower())
    return out


def label_roles(lines: DataFrame, companies: list[str] | None = None, company_patterns: list[str] | None = None) -> DataFrame:
    """lines (call_id, line_no, line) with roles for labels, and how they were told.

    Adds `method` (company, intro, client_content, direction; null for calls without a
    Speaker label, which stay as they are), and `intro_on_client`: whether a line that
    became the client's introduces an agent. companies are names to look for in the text;
    company_patterns further patterns for what follows "I'm from". A speaker is its label
    in lower case, so "Speaker 0" and "Speaker0" differ.
    """
    intro = rules.AGENT_INTRO[:7] + [rules.AGENT_INTRO_COMPANY.replace("{names}", "|".join([*(company_patterns or []), "the company"]))] + rules.AGENT_INTRO[7:]
    rows = lines.select("call_id", F.col("line_no").alias("pos"), "line", F.lower(F.nullif(F.regexp_extract("line", _LABEL, 1), F.lit(""))).alias("speaker"))
    rows = merge_minor(rows, F.col("speaker").isNotNull().cast("int"), keep_first=True)
    content = F.when(F.col("speaker").isNotNull(), F.nullif(F.regexp_extract("line", r"(?iUs)^Speaker\s*\d+\s*:\s*(.+)", 1), F.lit("")))
    rows = rows.withColumn("_content", content).withColumn("_low", F.lower("_content"))
    has = F.col("_content").isNotNull()
    announced = has & _contains_any(F.col("_low"), rules.ANNOUNCEMENTS)
    matches = lambda patterns: F.col("_content").rlike(rules.any_of(patterns).replace("(?i)", "(?iU)"))
    rows = rows.withColumn("_n", F.sum(has.cast("int")).over(_upto())).withColumn("_m", F.sum((has & ~announced).cast("int")).over(_upto()))
    company = has & (F.col("_n") <= SCAN_COMPANY) & ~announced & _contains_any(F.col("_low"), companies or []) & (matches(rules.AGENT_BEHAVIOUR) | matches(rules.INBOUND_AGENT))
    early = has & (F.col("_m") <= SCAN_INTRO) & ~announced
    speaks = F.col("speaker").isNotNull()

    def first(condition: Column, value: str = "effective") -> Column:
        return F.min_by(F.when(condition, F.col(value)), F.when(condition, F.col("pos"))).over(_call())

    rows = rows.withColumn("_first", first(speaks, "speaker"))
    rows = rows.withColumn("_second", first(speaks & (F.col("speaker") != F.col("_first")), "speaker"))
    rows = rows.withColumn("_company", first(company)).withColumn("_intro", F.coalesce(first(early & matches(intro)), first(early & matches(rules.INBOUND_AGENT))))
    rows = rows.withColumn("_client", first(has & (F.col("_n") <= SCAN_CLIENT) & matches(rules.CLIENT)))
    other = F.when(F.col("_client").isNotNull(), F.when(F.col("_first") != F.col("_client"), F.col("_first")).otherwise(F.col("_second")))
    agent = F.coalesce(F.col("_company"), F.col("_intro"), other, F.col("_second"), F.col("_first"))
    method = F.when(F.col("_first").isNull(), None).when(F.col("_company").isNotNull(), "company").when(F.col("_intro").isNotNull(), "intro").when(other.isNotNull(), "client_content").otherwise("direction")
    rows = rows.withColumn("_role", F.when(speaks, F.when(F.col("effective") == agent, "Agent").otherwise("Client"))).withColumn("method", method)
    line = F.when(speaks, F.concat("_role", F.lit(": "), F.regexp_replace("line", _LABEL, ""))).otherwise(F.col("line"))
    odd = F.col("_role").eqNullSafe(F.lit("Client")) & F.coalesce(matches(intro), F.lit(False))
    return rows.select("call_id", F.col("pos").alias("line_no"), line.alias("line"), "method", F.max(odd).over(_call()).alias("intro_on_client"))


def speaker_order(lines: DataFrame) -> DataFrame:
    """(call_id, first_speaker, second_speaker) by first appearance, of rows (call_id, line_no, speaker)."""
    seen = lines.where("speaker is not null").groupBy("call_id", "speaker").agg(F.min("line_no").alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "speaker")))
    return seen.groupBy("call_id").agg(ordered.alias("o")).select("call_id", F.get("o", 0)["speaker"].alias("first_speaker"), F.get("o", 1)["speaker"].alias("second_speaker"))


def top_speakers(lines: DataFrame, k: int = 2) -> DataFrame:
    """(call_id, speaker, n, rank) of the k speakers with most lines, the earlier one in a tie."""
    counts = lines.where("speaker is not null").groupBy("call_id", "speaker").agg(F.count("*").alias("n"), F.min("line_no").alias("at"))
    ranked = counts.withColumn("rank", F.row_number().over(_call().orderBy(F.desc("n"), "at")))
    return ranked.where(F.col("rank") <= k).drop("at")
