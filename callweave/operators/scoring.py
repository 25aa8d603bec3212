"""Weighted scoring of verdicts, by call and category, and talk shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numbers import exact_round
from ..functions.text import word_count

_WEIGHT = "decimal(10,4)"


def applicable(calls: DataFrame, criteria: DataFrame) -> DataFrame:
    """calls (.., follow_up boolean) with each criterion that applies to their type.

    criteria (key, category, weight, applicability, ordinal) are users' own, so it is left to
    Catalyst, by their size, whether they are broadcast; both types are spelled out for an
    equi-join.
    """
    kinds = F.when(F.col("applicability") == "both", F.array(F.lit("first_only"), F.lit("second_only"))).otherwise(F.array("applicability"))
    typed = calls.withColumn("_kind", F.when(F.col("follow_up"), "second_only").otherwise("first_only"))
    return typed.join(criteria.withColumn("_kind", F.explode(kinds)), "_kind").drop("_kind")


def weighted(verdicts: DataFrame, criteria: DataFrame) -> DataFrame:
    """verdicts (call_id, key, score, ..) with category and weight; unknown keys get 1.0 and unknown."""
    dim = criteria.select("key", F.col("category").alias("_category"), F.col("weight").alias("_weight"))
    out = verdicts.join(dim, "key", "left")
    return out.withColumn("category", F.coalesce("_category", F.lit("unknown"))).withColumn("weight", F.coalesce("_weight", F.lit(1.0))).drop("_category", "_weight")


def _points() -> tuple[Column, Column]:
    """Points and weight of a verdict, exact decimals; N/A counts for neither."""
    weight = F.col("weight").cast(_WEIGHT)
    counted = F.col("score") != "N/A"
    share = F.when(F.col("score") == "YES", 2).when(F.col("score") == "PARTIAL", 1).otherwise(0)
    return F.when(counted, weight * share), F.when(counted, weight)


def score_calls(verdicts: DataFrame) -> DataFrame:
    """One row per call: score, points, weight, counts by verdict and confidence.

    verdicts: call_id, score, weight. Anything but YES, PARTIAL and N/A (a null too)
    counts as NO. Sums are decimals, so the result does not depend on their order.
    """
    verdicts = verdicts.withColumn("score", F.coalesce("score", F.lit("NO")))
    double_points, weight = _points()
    is_ = lambda v: F.sum(F.when(F.col("score") == v, 1).otherwise(0))
    out = verdicts.groupBy("call_id").agg(
        (F.coalesce(F.sum(double_points), F.lit(0)).cast("double") / 2).alias("points"),
        F.coalesce(F.sum(weight), F.lit(0)).cast("double").alias("weight_sum"),
        is_("YES").alias("yes_count"),
        is_("PARTIAL").alias("partial_count"),
        is_("N/A").alias("na_count"),
        F.count("*").alias("n"),
    )
    scored = F.col("n") - F.col("na_count")
    no = scored - F.col("yes_count") - F.col("partial_count")
    coverage = scored / F.greatest(F.lit(1), F.col("n"))
    agreement = (F.col("yes_count") + no) / F.greatest(F.lit(1), scored)
    confidence = coverage * 0.5 + agreement * 0.3 + F.least(F.lit(1.0), scored / 10) * 0.2
    score = F.when(F.col("weight_sum") > 0, F.col("points") / F.col("weight_sum") * 100).otherwise(0.0)
    return out.select(
        "call_id",
        exact_round(score, 1).alias("overall_score"),
        exact_round(F.col("points"), 2).alias("total_points"),
        exact_round(F.col("weight_sum"), 2).alias("total_weight"),
        "yes_count",
        "partial_count",
        no.alias("no_count"),
        "na_count",
        exact_round(coverage, 3).alias("coverage"),
        exact_round(agreement, 3).alias("agreement"),
        exact_round(confidence, 3).alias("confidence"),
    )


def score_categories(verdicts: DataFrame) -> DataFrame:
    """(call_id, category, category_score, n) where a category has any verdict but N/A."""
    double_points, weight = _points()
    out = verdicts.withColumn("score", F.coalesce("score", F.lit("NO"))).where("score <> 'N/A'").groupBy("call_id", "category")
    out = out.agg((F.sum(double_points).cast("double") / 2).alias("p"), F.sum(weight).cast("double").alias("w"), F.count("*").alias("n"))
    return out.select("call_id", "category", exact_round(F.when(F.col("w") > 0, F.col("p") / F.col("w") * 100).otherwise(0.0), 1).alias("category_score"), "n")


def pivot_summary(calls: DataFrame, categories: DataFrame, names: list[str]) -> DataFrame:
    """score_calls() rows with a column for each category, in order; 0 where there is none."""
    wide = categories.groupBy("call_id").pivot("category", sorted(names)).agg(F.first("category_score"))
    return calls.join(wide, "call_id", "left").na.fill(0.0, sorted(names))


def details(evaluations: DataFrame, criteria: DataFrame) -> DataFrame:
    """One row per call and criterion of evaluations (call_id, criteria map<key, struct<score, evidence>>)."""
    rows = evaluations.select("call_id", F.explode("criteria").alias("key", "verdict")).select("call_id", "key", "verdict.score", "verdict.evidence")
    return weighted(rows, criteria)


def listening_ratio(lines: DataFrame) -> DataFrame:
    """Talk shares of agent and client from lines (call_id, line) that start with a label.

    Words include the label. Lines without a label do not count. One side without words
    gives 0 and 100, none at all 50 and 50, each with a warning. Calls without lines do
    not appear.
    """
    low = F.lower(F.regexp_replace("line", r"(?U)^\s+", ""))
    starts = lambda labels: low.rlike("^(?:" + "|".join(labels) + ")")
    agent, client = starts(rules.AGENT_LABELS), starts(rules.CLIENT_LABELS)
    words = word_count(F.col("line"))
    sums = lines.groupBy("call_id").agg(
        F.sum(F.when(agent, words).otherwise(0)).alias("agent_words"),
        F.sum(F.when(client & ~agent, words).otherwise(0)).alias("client_words"),
    )
    total = F.col("agent_words") + F.col("client_words")
    pct = lambda c: exact_round(F.when(total > 0, F.col(c) / total * 100).otherwise(50.0), 1)
    warning = F.when(total == 0, "no_labeled_lines").when(F.col("agent_words") == 0, "agent_zero_words").when(F.col("client_words") == 0, "client_zero_words")
    return sums.select("call_id", pct("agent_words").alias("agent_percentage"), pct("client_words").alias("client_percentage"), total.alias("total_words"), warning.alias("ratio_warning"))
