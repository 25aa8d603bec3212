"""A whole run: from transcripts to scored results, with a pluggable scorer."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import control, roles, scoring, truncate, turns, verdicts


class Scorer(Protocol):
    """What grades a transcript: answers(prompts) gives a raw answer for each."""

    provider: str

    def answers(self, prompts: list[str]) -> list[str]: ...


class ProviderError(Exception):
    """A failure of a provider; kind is one of the names of text.error_class()."""

    def __init__(self, kind: str, retry_after: float | None = None):
        super().__init__(kind)
        self.kind, self.retry_after = kind, retry_after


@dataclass
class Chain:
    """Providers in order. One that is out of quota or misconfigured is left out for the
    rest of the run; a limited one is asked once more after a pause; any other failure
    passes the call on."""

    providers: list[tuple[str, Callable[[str], str]]]
    sleep: Callable[[float], None] = time.sleep
    disabled: set[str] = field(default_factory=set)

    def ask(self, prompt: str) -> tuple[str, str]:
        """(provider, answer); raises the last failure if all fail."""
        last = ProviderError("no_provider")
        for name, call in self.providers:
            if name in self.disabled:
                continue
            for attempt in range(2):
                try:
                    return name, call(prompt)
                except ProviderError as e:
                    last = e
                    if e.kind in ("quota_exhausted", "invalid_config"):
                        self.disabled.add(name)
                    if e.kind != "rate_limit" or attempt:
                        break
                    self.sleep(e.retry_after or 2.0)
        raise last

    def reset(self) -> None:
        self.disabled.clear()


@dataclass
class RuleScorer:
    """Grades by words: a criterion is met if one of its words occurs. For tests and dry runs."""

    words: dict[str, list[str]]
    provider: str = "rules"

    def answers(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            low = p.lower()
            found = {k: {"score": "YES" if any(w in low for w in ws) else "NO", "evidence": ""} for k, ws in self.words.items()}
            out.append(json.dumps({"criteria": found, "overall_assessment": "", "strengths": [], "improvements": []}))
        return out


def ask(df: DataFrame, scorer: Scorer, column: str = "prompt") -> DataFrame:
    """df with `answer` of the scorer, asked in batches on the executors."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "answer string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(answer=scorer.answers(batch[column].tolist()))

    return df.mapInPandas(run, schema)


def prepare(transcripts: DataFrame, max_tokens: int = 30_000, companies: list[str] | None = None) -> DataFrame:
    """transcripts (call_id, filename, transcript, result, status) ready to be graded.

    Adds call_type, method, cleaned (roles, white space, cut to the budget), removed_pct
    and error: TOO_SHORT, or what input_error() says. Where transcripts have a column
    stt_status, only those with Success are taken, as others have no text to be graded.
    """
    if "stt_status" in transcripts.columns:
        transcripts = transcripts.where("stt_status = 'Success'")
    labelled = roles.label_roles(turns.split_lines(transcripts.select("call_id", F.coalesce("transcript", F.lit("")).alias("transcript"))), companies)
    methods = labelled.groupBy("call_id").agg(F.max("method").alias("method"))
    texts = turns.transcripts(labelled).select("call_id", text.clean(F.col("transcript")).alias("cleaned"))
    out = transcripts.join(texts, "call_id").join(methods, "call_id")
    out = out.withColumn("call_type", text.call_type(F.col("result"), F.col("status"), F.col("filename"), F.col("transcript")))
    out = out.withColumn("error", F.when(text.too_short(F.col("transcript")), "TOO_SHORT").otherwise(text.input_error(F.col("transcript"))))
    out = truncate.truncate(out, max_tokens, "cleaned")
    removed = F.when(F.col("cut.truncated"), F.col("cut.removed_percentage"))
    return out.withColumn("removed_pct", removed).withColumn("cleaned", F.col("cut.text")).drop("cut")


def evaluate(transcripts: DataFrame, criteria: DataFrame, scorer: Scorer, max_tokens: int = 30_000, companies: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, details) of transcripts: a row per call, and one per call and criterion.

    Calls whose answer fails the checks, or that are too short, are in results with an
    error and without a score.
    """
    ready = prepare(transcripts, max_tokens, companies)
    answered = ask(ready.where("error is null").select("call_id", F.col("cleaned").alias("prompt")), scorer)
    expected = [r.key for r in criteria.select("key").collect()]  # a dimension of a few dozen rows
    parsed = verdicts.parse_answers(answered, expected).select("call_id", F.col("error").alias("answer_error"), "evaluation")
    rows = parsed.where("answer_error is null").select("call_id", F.explode("evaluation.criteria").alias("key", "verdict")).select("call_id", "key", "verdict.score", "verdict.evidence")
    details = scoring.weighted(rows, criteria)
    pii = parsed.select("call_id", "answer_error", verdicts.pii_affected(F.col("evaluation.criteria")).alias("pii_affected"))
    results = ready.join(pii, "call_id", "left").join(scoring.score_calls(details), "call_id", "left")
    results = results.withColumn("error", F.coalesce("error", "answer_error")).drop("answer_error")
    results = results.withColumn("warnings", text.warnings(F.col("removed_pct"), F.coalesce("pii_affected", F.lit(0)), F.col("method")))
    results = results.withColumn("agents", text.agent_names(F.col("cleaned"))).withColumn("word_count", text.word_count(F.col("transcript"))).withColumn("provider_used", F.lit(scorer.provider))
    return results, details


def publish(results: DataFrame, seq: str = "call_id", limit: int = 3) -> DataFrame:
    """Results of a run (run_id, ..) up to its circuit breaker, without failed rows."""
    failed = F.col("error").isNotNull()
    scored = F.coalesce(F.col("yes_count") + F.col("partial_count") + F.col("no_count"), F.lit(0)) > 0
    return control.circuit_breaker(results, failed, scored, limit, "run_id", seq).where(~failed).drop("failures", "tripped", "remaining")


