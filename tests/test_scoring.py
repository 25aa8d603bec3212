import pytest
from pyspark.sql import functions as F

from callweave.functions.numbers import exact_round
from callweave.operators import report, scoring, verdicts
from callweave.sources import readers


def test_exact_round_equals_python(spark):
    values = [0.25, 12.35, 6.25, 1.005, 2.675, -12.35, -0.25, 0.5, 1.5, 2.5, 99.95, 0.0, 33.333333, 1e9 + 0.05, 0.05, 0.15, 0.00049]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[exact_round(F.col("v"), p).alias(f"p{p}") for p in (0, 1, 2, 3, 6)]).collect()
    for r in rows:
        for p in (0, 1, 2, 3, 6):
            assert r[f"p{p}"] == round(r.v, p), (r.v, p)


def _verdicts(spark, rows):
    return spark.createDataFrame(rows, "call_id long, score string, weight double, category string")


def test_scores(spark):
    rows = [(1, "YES", 1.5, "a"), (1, "PARTIAL", 1.0, "a"), (1, "NO", 0.5, "b"), (1, "N/A", 9.0, "c"), (2, "N/A", 1.0, "a"), (3, "odd", 1.0, "a"), (3, None, 1.0, "a")]
    got = {r.call_id: r for r in scoring.score_calls(_verdicts(spark, rows)).collect()}
    one = got[1]
    assert (one.overall_score, one.total_points, one.total_weight) == (round(2 / 3 * 100, 1), 2.0, 3.0)
    assert (one.yes_count, one.partial_count, one.no_count, one.na_count) == (1, 1, 1, 1)
    assert one.confidence == round(0.5 * 3 / 4 + 0.3 * 2 / 3 + 0.2 * 0.3, 3)
    assert got[2].overall_score == 0.0 and got[2].na_count == 1
    assert got[3].overall_score == 0.0 and got[3].no_count == 2
    cats = {(r.call_id, r.category): r.category_score for r in scoring.score_categories(_verdicts(spark, rows)).collect()}
    assert cats == {(1, "a"): 80.0, (1, "b"): 0.0, (3, "a"): 0.0}


def test_scores_of_nothing(spark):
    empty = _verdicts(spark, [])
    assert scoring.score_calls(empty).count() == 0 and scoring.score_categories(empty).count() == 0


@pytest.mark.parametrize(
    ("lines", "expected"),
    [
        (["Agent: a b c", "Client: d"], (66.7, 33.3, 6, None)),
        (["nobody: x"], (50.0, 50.0, 0, "no_labeled_lines")),
        (["caller: x y"], (0.0, 100.0, 3, "agent_zero_words")),
        (["  Rep: x", "stray line"], (100.0, 0.0, 2, "client_zero_words")),
    ],
)
def test_listening_ratio(spark, lines, expected):
    df = spark.createDataFrame([(1, x) for x in lines], "call_id long, line string")
    r = scoring.listening_ratio(df).first()
    assert (r.agent_percentage, r.client_percentage, r.total_words, r.ratio_warning) == expected


def test_criteria_keep_the_last_of_a_key(spark):
    config = {"x": {"k1": {"weight": 0.5}, "k2": {"description": "d"}}, "y": {"k1": {"call_applicability": "first_only"}}}
    rows = [tuple(r) for r in readers.criteria(spark, config).collect()]
    assert rows == [("k1", "y", 1.0, "first_only", "", 1), ("k2", "x", 1.0, "both", "d", 2)]
    calls = spark.createDataFrame([(1, False), (2, True)], "call_id long, follow_up boolean")
    assert {(r.call_id, r.key) for r in scoring.applicable(calls, readers.criteria(spark, config)).collect()} == {(1, "k1"), (1, "k2"), (2, "k2")}


def test_unknown_key_takes_defaults(spark):
    rows = spark.createDataFrame([(1, "gone", "YES")], "call_id long, key string, score string")
    r = scoring.weighted(rows, readers.criteria(spark, {"x": {"k": {}}})).first()
    assert (r.category, r.weight) == ("unknown", 1.0)


GOOD = '{"criteria": {"a": {"score": "yes", "evidence": "[EMAIL]"}}, "overall_assessment": "ok", "strengths": [], "improvements": []}'


@pytest.mark.parametrize(
    ("answer", "error"),
    [
        (GOOD, None), (f"Here:\n```json\n{GOOD}\n```", None), (f"```\n{GOOD}\n```", None), ("{broken " + GOOD, None), (None, "no_json"), ("", "no_json"), ("no json", "no_json"),
        ("[1]", "not_an_object"), ('{"criteria": {}}', "missing_fields"), (GOOD.replace('{"a": {"score": "yes", "evidence": "[EMAIL]"}}', "3"), "bad_criteria"),
        (GOOD.replace('"a"', '"b"'), "missing_keys"), (GOOD.replace("yes", "perhaps"), "invalid_scores"),
    ],
)
def test_answers(spark, answer, error):
    r = verdicts.parse_answers(spark.createDataFrame([(answer,)], "answer string"), ["a"]).first()
    assert r.error == error
    if error is None:
        assert r.evaluation.criteria["a"].score == "YES"


def test_pii_and_export_columns(spark):
    df = spark.createDataFrame([({"a": ("YES", "x [EMAIL] y"), "b": ("NO", None)}, "s")], "criteria map<string,struct<score:string,evidence:string>>, raw_text string")
    assert df.select(verdicts.pii_affected(F.col("criteria"))).first()[0] == 1
    assert verdicts.exportable(df).columns == ["criteria"]


def test_length_score_needs_three_pairs(spark):
    df = spark.createDataFrame([(1.0, 10), (2.0, 20), (0.0, 5)], "overall_score double, word_count int")
    assert report.length_score(df).count() == 0
    same = spark.createDataFrame([(5.0, 10), (5.0, 20), (5.0, 30)], "overall_score double, word_count int")
    assert report.length_score(same).first().r == 0.0


def test_run_summary(spark):
    df = spark.createDataFrame([(80.0, 0.1, 10, 1, "b"), (60.0, 0.2, 20, 2, "a")], "overall_score double, cost_usd double, tokens_in long, tokens_out long, provider_used string")
    r = report.run_summary(df, 1.0).first()
    assert (r.calls, r.avg_score, r.score_stddev, r.llm_cost, r.providers) == (2, 70.0, 10.0, 0.3, "a,b")
    assert report.run_summary(df.limit(1)).first().score_stddev is None
