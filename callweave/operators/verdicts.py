"""From raw model answers to validated verdicts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import jsonspans, rules

REQUIRED = ["criteria", "overall_assessment", "strengths", "improvements"]
ANSWER = "criteria map<string,struct<score:string,evidence:string>>, overall_assessment string, strengths array<string>, improvements array<string>, critical_gaps array<string>"

#: Bytes of answers that are indexed at once.
_INDEXED = 2 << 20



_NOTHING = object()


def _whole(text: str) -> object:
    """The value that a text or a fenced block of it is, or _NOTHING."""
    candidates = [text]
    for mark in ("```json", "```"):
        first = text.find(mark)
        last = text.find("```", first + len(mark)) if first >= 0 else -1
        if last >= 0:
            candidates.append(text[first + len(mark) : last].strip())
    for candidate in candidates:
        try:
            return json.loads(candidate)
        except ValueError:  # not JSON, or a number of too many digits
            continue
    return _NOTHING


def find_all(texts: list[str | None]) -> list[object | None]:
    """The JSON value of each answer: the whole of it, a fenced block, or the first object in it.

    An answer that is nested too deeply to be read has none, nor has a number too long to
    be one. The texts that need a search share one structural index (jsonspans).
    """
    out: list[object | None] = [None] * len(texts)
    open_ones: list[tuple[int, bytes]] = []
    for i, t in enumerate(texts):
        text = (t or "").strip()
        try:
            value = _whole(text)
        except RecursionError:
            continue
        if value is not _NOTHING:
            out[i] = value
        elif "{" in text:
            open_ones.append((i, text.encode("utf-8", "surrogatepass")))
    while open_ones:
        some, size = [], 0
        while open_ones and (not some or size + len(open_ones[-1][1]) <= _INDEXED):
            some.append(open_ones.pop())
            size += len(some[-1][1])
        for (i, text), found in zip(some, jsonspans.spans([t for _, t in some]), strict=True):
            try:
                out[i] = jsonspans.first_object(text, found)
            except RecursionError:
                out[i] = None
    return out


def find_json(text: str | None) -> object | None:
    """The JSON value of one answer."""
    return find_all([text])[0]


def _dumped(value: object) -> str | None:
    try:
        return None if value is None else json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return None


@F.pandas_udf(StringType())
def _json_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([_dumped(v) for v in find_all(texts.tolist())], dtype=object)


def extract_json(text: Column) -> Column:
    """The answer's JSON as a string, null if there is none. Exact, hence not from_json:
    that takes trailing rubbish and turns broken objects into nulls."""
    return _json_of(text)


def missing_note(missing: Column, shown: int = 5) -> Column:
    """What is said of missing keys: the first five by name, and how many more there are."""
    more = F.size(missing) - shown
    named = F.concat(F.lit("Missing criteria: "), F.array_join(F.slice(missing, 1, shown), ", "))
    return F.when(F.size(missing) > 0, F.when(more > 0, F.concat(named, F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(named))


def invalid_score(score: Column) -> Column:
    """Whether a score, in either case, is none of the known verdicts; null is none."""
    return F.coalesce(~F.upper(score).isin(rules.SCORES), F.lit(True))


def parse_answers(answers: DataFrame, expected: list[str], column: str = "answer") -> DataFrame:
    """answers with `error`, `missing_keys`, `unexpected_keys` and the parsed `evaluation`.

    error is no_json, not_an_object, missing_fields, bad_criteria, missing_keys or
    invalid_scores, the first that applies, else null; evaluation is null with an error.
    Scores are put in upper case.
    """
    found = answers.withColumn("_json", extract_json(F.col(column)))
    got = F.from_json("_json", ANSWER)
    fields = F.json_object_keys("_json")
    keys = F.coalesce(F.json_object_keys(F.get_json_object("_json", "$.criteria")), F.array().cast("array<string>"))
    out = found.withColumn("_got", got).withColumn("_keys", keys)
    want = F.array(*[F.lit(k) for k in expected])
    missing = F.array_sort(F.array_except(want, F.col("_keys")))
    bad = F.coalesce(F.exists(F.map_values("_got.criteria"), lambda v: invalid_score(v["score"])), F.lit(False))
    criteria = F.get_json_object("_json", "$.criteria")
    error = (
        F.when(F.col("_json").isNull(), "no_json")
        .when(~F.ltrim("_json").startswith("{"), "not_an_object")
        .when(F.size(F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), fields)) > 0, "missing_fields")
        .when(~F.coalesce(criteria, F.lit("")).startswith("{"), "bad_criteria")
        .when(F.size(missing) > 0, "missing_keys")
        .when(bad, "invalid_scores")
    )
    upper = F.transform_values("_got.criteria", lambda _, v: F.struct(F.upper(v["score"]).alias("score"), v["evidence"].alias("evidence")))
    out = out.withColumn("error", error).withColumn("missing_keys", missing).withColumn("unexpected_keys", F.array_sort(F.array_except("_keys", want)))
    out = out.withColumn("evaluation", F.when(F.col("error").isNull(), F.col("_got").withField("criteria", upper)))
    return out.drop("_json", "_got", "_keys")


def pii_affected(criteria: Column) -> Column:
    """Number of verdicts of a map whose evidence holds a mask of personal data."""
    tagged = lambda e: F.exists(F.array(*[F.lit(t) for t in rules.PII_TAGS]), lambda t: F.contains(e, t))
    return F.coalesce(F.size(F.filter(F.map_values(criteria), lambda v: tagged(F.coalesce(v["evidence"], F.lit(""))))), F.lit(0))


def exportable(df: DataFrame) -> DataFrame:
    """Without the columns that must not leave the engine."""
    return df.drop(*rules.NOT_EXPORTED)
