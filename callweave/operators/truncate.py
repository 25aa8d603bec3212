"""Token-budgeted truncation: start, middle and end of a transcript, by whole lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numbers import exact_round
from ..functions.text import token_estimate

START_SHARE, MIDDLE_SHARE = 0.30, 0.40
#: Two marks of five words each.
MARK_TOKENS = 2 * int(5 * rules.TOKENS_PER_WORD)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def lines_within(costs: Column, budget: int) -> Column:
    """How many lines fit before the first that does not."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, cost: Column) -> Column:
        stop = s["done"] | (s["sum"] + cost > budget)
        return F.struct(F.when(stop, s["sum"]).otherwise(s["sum"] + cost).alias("sum"), F.when(stop, s["n"]).otherwise(s["n"] + 1).alias("n"), stop.alias("done"))

    return F.aggregate(costs, start, step, lambda s: s["n"])


def middle_out(costs: Sequence[int], budget: int) -> list[int]:
    """Sorted indices of the lines that fit, visited from the middle outwards.

    Round r looks at middle + r, then at middle - r; a line that does not fit is passed
    over. After a round in which the budget was reached no further one begins.
    """
    n = len(costs)
    middle, spent, kept = n // 2, 0, []
    for r in range(max(middle, n - middle - 1) + 1 if n else 0):
        if r and spent >= budget:
            break
        for i in (middle + r, middle - r) if r else (middle,):
            if 0 <= i < n and spent + costs[i] <= budget:
                spent += costs[i]
                kept.append(i)
    return sorted(kept)


def _middle(costs: Column, budget: int) -> Column:
    """middle_out() of an array column. One choice depends on all before it, and a fold in
    columns would copy what it has kept at each line, hence Arrow; null stays null."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrays in batches:
            yield pd.Series([None if a is None else middle_out(a.tolist(), budget) for a in arrays], dtype=object)

    return run(costs)


def truncate(df: DataFrame, max_tokens: int, column: str = "transcript") -> DataFrame:
    """df with `cut`: text, truncated, original_tokens, final_tokens, removed_tokens,
    removed_percentage, kept_lines and total_lines of a transcript column.

    A transcript within the budget stays as it is. Tokens are estimated by words, line by
    line and so rounded down for each, which is why start and end can overlap and repeat
    lines when a transcript is just over the budget. Null counts as empty.
    """
    budget = max_tokens - MARK_TOKENS
    first, middle = int(budget * START_SHARE), int(budget * MIDDLE_SHARE)
    last = budget - first - middle
    text = F.coalesce(F.col(column), F.lit(""))
    out = df.withColumn("_tokens", token_estimate(text)).withColumn("_lines", F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), token_estimate(x).alias("cost"))))
    over = F.col("_tokens") > max_tokens
    costs = F.transform("_lines", lambda x: x["cost"])
    out = out.withColumn("_total", F.size("_lines")).withColumn("_head", F.when(over, lines_within(costs, first)).otherwise(0)).withColumn("_tail", F.when(over, lines_within(F.reverse(costs), last)).otherwise(0))
    between = F.greatest(F.lit(0), F.col("_total") - F.col("_tail") - F.col("_head"))
    out = out.withColumn("_gap", F.when(over, F.slice("_lines", F.col("_head") + 1, between)))
    out = out.withColumn("_kept", _middle(F.transform("_gap", lambda x: x["cost"]), middle))
    join = lambda lines: F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    centre = _let(F.struct(F.col("_gap").alias("gap"), F.col("_kept").alias("kept")), lambda s: F.array_join(F.transform(s["kept"], lambda i: F.get(s["gap"], i)["line"]), "\n"))
    whole = F.concat(
        join(F.slice("_lines", F.lit(1), F.col("_head"))),
        F.lit(rules.CUT_MARK),
        F.when(F.size("_kept") > 0, F.concat(centre, F.lit(rules.CUT_MARK))).otherwise(""),
        join(F.slice("_lines", F.col("_total") - F.col("_tail") + 1, F.greatest(F.lit(0), F.col("_tail")))),
    )
    out = out.withColumn("_new", F.when(over, whole).otherwise(F.col(column))).withColumn("_final", F.when(over, token_estimate(F.col("_new"))).otherwise(F.col("_tokens")))
    removed = F.col("_tokens") - F.col("_final")
    cut = F.struct(
        F.col("_new").alias("text"),
        over.alias("truncated"),
        F.col("_tokens").alias("original_tokens"),
        F.col("_final").alias("final_tokens"),
        removed.alias("removed_tokens"),
        F.when(over, exact_round(removed / F.col("_tokens") * 100, 1)).otherwise(0.0).alias("removed_percentage"),
        F.when(over, F.col("_head") + F.size("_kept") + F.col("_tail")).otherwise(F.col("_total")).alias("kept_lines"),
        F.col("_total").alias("total_lines"),
    )
    return out.withColumn("cut", cut).select(*[f"`{c}`" for c in df.columns], "cut")
