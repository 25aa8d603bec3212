"""Run reports: summaries, correlation and cost roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import exact_round

_MONEY = "decimal(18,6)"


def run_summary(results: DataFrame, budget: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Totals of results (overall_score, cost_usd, tokens_in, tokens_out, provider_used).

    score_stddev is of the population, and null below two calls. Money is summed as
    decimals.
    """
    money = F.coalesce(F.sum(F.col("cost_usd").cast(_MONEY)), F.lit(0)).cast("double")
    out = results.groupBy(*(by or [])).agg(
        F.count("*").alias("calls"),
        F.avg("overall_score").alias("avg_score"),
        F.max("overall_score").alias("max_score"),
        F.min("overall_score").alias("min_score"),
        F.when(F.count("overall_score") > 1, F.stddev_pop("overall_score")).alias("score_stddev"),
        money.alias("llm_cost"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.array_join(F.array_sort(F.collect_set("provider_used")), ",").alias("providers"),
    )
    if budget is not None:
        out = out.withColumn("budget_used_pct", F.col("llm_cost") / budget * 100).withColumn("budget_left", F.lit(budget) - F.col("llm_cost"))
    return out


def webhook_summary(results: DataFrame) -> DataFrame:
    """Average score (one place), cost (four places) and number of calls."""
    out = results.agg(F.avg("overall_score").alias("a"), F.coalesce(F.sum(F.col("cost_usd").cast(_MONEY)), F.lit(0)).cast("double").alias("c"), F.count("*").alias("total_calls"))
    return out.select(F.coalesce(exact_round(F.col("a"), 1), F.lit(0.0)).alias("average_score"), exact_round(F.col("c"), 4).alias("total_cost"), "total_calls")


def stt_summary(transcripts: DataFrame) -> DataFrame:
    """Successes, cost, cache hits and what these saved, of transcripts (status, cost_usd, cached, minutes)."""
    return transcripts.agg(
        F.count_if(F.col("status") == "Success").alias("succeeded"),
        F.coalesce(F.sum(F.col("cost_usd").cast(_MONEY)), F.lit(0)).cast("double").alias("cost"),
        F.count_if("cached").alias("cache_hits"),
        F.coalesce(F.sum(F.when(F.col("cached"), F.col("minutes").cast(_MONEY))), F.lit(0)).cast("double").alias("cached_minutes"),
    ).select("succeeded", "cost", "cache_hits", (F.col("cached_minutes") * 0.005).alias("saved"))


def length_score(results: DataFrame) -> DataFrame:
    """Correlation of word_count and overall_score over rows where both are positive.

    No row for fewer than three pairs; r is 0 where one side does not vary.
    """
    x, y = F.col("word_count").cast("double"), F.col("overall_score").cast("double")
    spread = F.stddev_pop(x) * F.stddev_pop(y)  # corr() itself fails in ANSI mode where it is 0
    pairs = results.where("overall_score > 0 and word_count > 0").agg(F.count("*").alias("n"), F.try_divide(F.covar_pop(x, y), spread).alias("r"))
    r = F.coalesce("r", F.lit(0.0))
    size = F.abs(r)
    return pairs.where("n >= 3").select("n", r.alias("r"), (r * r).alias("r2"), F.when(size < 0.3, "weak").when(size < 0.7, "moderate").otherwise("strong").alias("strength"))


def length_score_pairs(results: DataFrame) -> DataFrame:
    """The pairs that length_score() correlates, in order of words and score, as report lines."""
    line = F.format_string("%,8d words | %6.1f/100", F.col("word_count").cast("long"), F.col("overall_score").cast("double"))
    return results.where("overall_score > 0 and word_count > 0").select("word_count", "overall_score", line.alias("line")).orderBy("word_count", "overall_score")


def events_by_kind(metrics: DataFrame) -> DataFrame:
    """Number of metric events of each kind."""
    return metrics.groupBy("event").agg(F.count("*").alias("n"))


def cost_rollup(results: DataFrame) -> DataFrame:
    """Cost by provider and run, by provider, and in all (nulls stand for all)."""
    return results.rollup("provider_used", "run_id").agg(F.count("*").alias("calls"), F.sum(F.col("cost_usd").cast(_MONEY)).cast("double").alias("cost"))


def export_summary(pivoted: DataFrame, categories: list[str]) -> DataFrame:
    """The sheet of one row per call, with its headings."""
    return pivoted.select(
        F.col("filename").alias("File"), F.col("call_type").alias("Type"), F.col("overall_score").alias("Score"), F.col("confidence").alias("Confidence"),
        *sorted(categories), F.col("yes_count").alias("YES"), F.col("partial_count").alias("PARTIAL"), F.col("no_count").alias("NO"), F.col("cost_usd").alias("Cost"),
    )


def criteria_text(criteria: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`text`: the criteria (key, category, weight, description, ordinal) as a numbered list, of all or of each group."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "key", "category", "weight", "description")))

    def entry(c: Column, i: Column) -> Column:
        return F.concat((i + 1).cast("string"), F.lit(". **"), c["key"], F.lit("** (Category: "), c["category"], F.lit(", Weight: "), c["weight"].cast("string"), F.lit(")\n   "), c["description"], F.lit("\n"))

    return criteria.groupBy(*(by or [])).agg(F.array_join(F.transform(ordered, entry), "\n").alias("text"))
