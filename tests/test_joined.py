"""Files that tasks write in parts: spreadsheets and JSON documents, read back."""

import datetime
import json
import math
import os
import random
import zipfile
import zlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from callweave.plans import registry
from callweave.sources import joined, workbook, writers

SF = "/root/testdata/sf0.001"


def test_checksums_of_pieces():
    r = random.Random(1)
    for _ in range(60):
        a, b = r.randbytes(r.randrange(50)), r.randbytes(r.choice([0, 1, 7, 300, 70_000]))
        assert workbook.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_pieces_follow_each_other():
    texts = [b"", b"abc" * 100, b"", b"x", b"end"]
    assert zlib.decompress(b"".join(workbook.packed(t, i == 4) for i, t in enumerate(texts)), -15) == b"".join(texts)


VALUES = [None, "", " a ", "<&>\"'", "line\nbreak\ttab", "\r", "\x00\x07", "_x0041_", "=1+1", "é漢😀", "]]>", "x" * 32_767]


@pytest.mark.parametrize("parts", [1, 5])
def test_workbook_reads_back(spark, tmp_path, monkeypatch, parts):
    monkeypatch.setattr(workbook, "PART_ROWS", 3)
    rows = [(i, VALUES[i % len(VALUES)], i / 3, i % 2 == 0, Decimal(i), datetime.date(2024, 1, 1), [i]) for i in range(30)]
    df = spark.createDataFrame(rows, "i long, t string, d double, b boolean, n decimal(9,2), day date, l array<int>").repartitionByRange(parts, "i").sortWithinPartitions("i")
    path = str(tmp_path / "a.xlsx")
    assert workbook.write_workbook({"Summary": df, "No rows": df.limit(0), "Details: [x]": df.select("i")}, path) == {"Summary": 30, "No rows": 0, "Details: [x]": 30}
    got = workbook.read_workbook(path)
    assert list(got) == ["Summary", "No rows", "Details_ _x_"]
    assert got["Summary"][0] == df.columns and got["No rows"] == [df.columns]
    for r, want in zip(got["Summary"][1:], rows, strict=True):
        assert r[:2] == [want[0], want[1]] and math.isclose(r[2], want[2]) and r[3:] == [want[3], float(want[4]), "2024-01-01", json.dumps(want[6])]
    assert [r[0] for r in got["Details_ _x_"][1:]] == list(range(30))
    assert os.listdir(tmp_path) in (["a.xlsx"], [".a.xlsx.crc", "a.xlsx"], ["a.xlsx", ".a.xlsx.crc"])


def test_a_long_table_goes_on_in_further_sheets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "SHEET_ROWS", 11)
    df = spark.range(43).repartitionByRange(9, "id").sortWithinPartitions("id")
    workbook.write_workbook({"Details": df}, str(tmp_path / "a.xlsx"))
    got = workbook.read_workbook(str(tmp_path / "a.xlsx"))
    assert all(rows[0] == ["id"] and len(rows) <= 11 for rows in got.values()) and list(got)[:2] == ["Details", "Details 2"]
    assert [r[0] for rows in got.values() for r in rows[1:]] == list(range(43))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    bad = spark.range(20).select(F.when(F.col("id") == 17, F.repeat(F.lit("x"), 40_000)).otherwise("ok").alias("t")).repartition(4)
    with pytest.raises(Exception, match="32767"):
        workbook.write_workbook({"A": spark.range(5), "B": bad}, str(tmp_path / "a.xlsx"))
    assert os.listdir(tmp_path) == []


def test_numbers_that_are_none(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), float("inf"), 1e300, -0.0)], "a double, b double, c double, d double")
    workbook.write_workbook({"A": df}, str(tmp_path / "a.xlsx"))
    assert workbook.read_workbook(str(tmp_path / "a.xlsx"))["A"][1] == ["NaN", "Infinity", 1e300, 0.0]


def test_summary_and_details_of_the_tables(spark, tmp_path):
    sheets = {"Summary": registry.queries()["summary_pivot"](spark, SF).orderBy("call_id"), "Details": registry.queries()["details_default_weight"](spark, SF).orderBy("call_id", "key")}
    path = str(tmp_path / "QM.xlsx")
    writers.write_workbook(sheets, path)
    got = workbook.read_workbook(path)
    for name, df in sheets.items():
        assert got[name][0] == df.columns
        assert [[float(x) if isinstance(x, int) else x for x in r] for r in got[name][1:]] == [[float(x) if isinstance(x, (int, Decimal)) else x for x in r] for r in df.collect()]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None


def test_json_document(spark, tmp_path):
    rows = [(f"c{i}", ['a "quote"', "é\n,\n", None, "]}"][i % 4], Decimal(i) / 7, "secret") for i in range(40)]
    df = spark.createDataFrame([(a, b, float(c), d) for a, b, c, d in rows], "filename string, note string, cost_usd double, raw_text string").repartition(7)
    path = str(tmp_path / "out.json")
    said = writers.write_json_document(df, path, "m", "2024-01-01", ["filename"])
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    want = sorted(({"filename": a, **({"note": b} if b is not None else {}), "cost_usd": float(c)} for a, b, c, _ in rows), key=lambda r: r["filename"])
    assert got["evaluations"] == want and got["metadata"] == said
    assert said["calls"] == 40 and said["cost_usd"] == pytest.approx(sum(round(float(r[2]), 6) for r in rows))
    assert not [f for f in os.listdir(tmp_path) if "parts" in f]


def test_json_document_without_rows(spark, tmp_path):
    df = spark.createDataFrame([], "filename string, cost_usd double")
    path = str(tmp_path / "out.json")
    assert writers.write_json_document(df, path, "m", "now") == {"generated": "now", "model": "m", "calls": 0, "cost_usd": 0.0}
    with open(path) as f:
        assert json.load(f)["evaluations"] == []


def test_places_of_pieces(spark, tmp_path):
    (tmp_path / "p").write_bytes(b"0123456789")
    target = str(tmp_path / "t")
    assert joined.join(spark, [b"ab", (str(tmp_path / "p"), 4), b"", (str(tmp_path / "p"), 10)], target) == [0, 2, 6, 6]
    assert (tmp_path / "t").read_bytes() == b"ab01230123456789"
    with pytest.raises(Exception):
        joined.join(spark, [b"x", (str(tmp_path / "p"), 99)], target)
    assert (tmp_path / "t").read_bytes() == b"ab01230123456789" and not [f for f in os.listdir(tmp_path) if f.startswith(".t.") and not f.endswith(".crc")]
