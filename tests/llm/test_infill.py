import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from callweave.llm import infill

TEXTS = [
    None, "", "a", "\n", "\n\n\n", "a\nb\nc\nd\ne", "a\nb\n", "one line", "x<P>y\nz", "a <S", "a\n<", "<\nM>\n<S\n>", "\x1e\x1f\x1fe\n\x1em\n\x1e", "é\n漢字\n😀\r\nz",
    "\r\n \t\n", "$0 $1 \\ \\1\n$\n", "line of text\n" * 5000, "w " * 300_000, "<M>", "ab\x00c\nd", "\u2028a\x85b\nc",
]


def straight(doc_id, text):
    """The definition, word for word."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def test_equals_the_definition(spark):
    rows = [(20 * k + i, t) for k in range(12) for i, t in enumerate(TEXTS[:16] + TEXTS[18:])] + [(900 + i, t) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc"), (5, "a\nb"), (5, "a\nb"), (-3, "a\nb\nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("form", F.lit(1)).withColumn("id", F.lit(2))
    got = sorted(map(tuple, infill.report(df).collect()), key=str)
    assert got == sorted((straight(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert infill.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_output_is_a_text(spark):
    [r] = infill.transform(spark.createDataFrame([(1, "a\nb\nc\n")], "doc_id long, text string")).collect()
    parts = re.fullmatch(r"<P>(.*)<S>(.*)<M>(.*)|<S>(.*)<P>(.*)<M>(.*)", r.output, re.S)
    assert parts and sorted("".join(x for x in parts.groups() if x)) == sorted("a\nb\nc\n")


@pytest.mark.parametrize("rate, spm, forms", [(0, 50, {"plain"}), (100, 100, {"spm"}), (100, 0, {"psm"})])
def test_rates(spark, rate, spm, forms):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"))
    out = infill.transform(df, rate=rate, spm_rate=spm).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert {r.form for r in out} == forms and {r.back for r in out} == {"a\nb\nc"}


def test_other_units(spark):
    df = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("a b  c d").alias("text"))
    out = infill.transform(df, unit=r"[^ ]* |[^ ]+").withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert {r.n for r in out} == {5} and {r.back for r in out} == {"a b  c d"}


def test_no_python_and_no_shuffle(spark):
    plan = infill.report(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_equals_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = infill.report(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({infill.oracle_sql()})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
