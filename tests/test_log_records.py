"""Log records of several lines, read in splits of any size."""

import random
import re

import pytest
from pyspark.sql import functions as F

from callweave.sources import readers

STAMP = "2024-05-01 10:00:{:02}"


def straight(text):
    """(stamp and head or None, message, lines) of the records of one file."""
    out = []
    for line in text.removesuffix("\n").split("\n"):
        if re.match(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\S* \[", line) or not out:
            out.append([line])
        else:
            out[-1].append(line)
    found = []
    for lines in out:
        whole = "\n".join(lines)
        m = re.match(r"(\S+ \S+) \[(\w+)\] (\S+) \[([^\]:]+):(\d+)\] (.*)$", whole, re.S)
        found.append((m[2], int(m[5]), m[6], len(lines)) if m else (None, None, whole, len(lines)))
    return found


@pytest.fixture
def splits(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {k: spark.conf.get(k, None) for k in keys}

    def put(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "0")
        spark.conf.set(keys[2], "1")

    yield put
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("size", [100, 1024, 1 << 27])
def test_splits_do_not_matter(spark, tmp_path, splits, size):
    r = random.Random(4)
    files = []
    for i in range(3):
        text = "before any stamp\nand more\n" if i == 1 else ""
        for n in range(60):
            more = r.choice([0, 0, 1, 3, 40 if n % 20 == 0 else 2])
            text += f"{STAMP.format(n)} [{r.choice(['INFO', 'ERROR'])}] app.x [run.py:{100 * i + n}] said é{n}\n" + "".join(r.choice(["  at line\n", "\n", "[not a stamp]\n", "2024-05-01 is a day\n"]) for _ in range(more))
        files.append(text)
        (tmp_path / f"{i}.log").write_text(text, encoding="utf-8")
    splits(size)
    got = readers.log_records(spark, str(tmp_path))
    assert sorted(((x.level, x.line, x.message, x.n_lines) for x in got.collect()), key=str) == sorted((x for f in files for x in straight(f)), key=str)
    ordered = [x.line for x in got.where(F.col("file").endswith("0.log")).orderBy("place").collect()]
    assert ordered == list(range(60))


def test_documents_split_and_whole(spark, tmp_path, splits):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    head = F.concat(F.lit("2024-05-01 10:00:00 [INFO] corpus [docs.py:"), F.col("doc_id").cast("string"), F.lit("] "))
    docs.select(F.concat(head, F.coalesce("text", F.lit(""))).alias("value")).coalesce(2).write.text(str(tmp_path / "log"))
    want = sorted((r.doc_id, r.text or "") for r in docs.collect())
    for size in (1024, 1 << 27):
        splits(size)
        assert sorted((x.line, x.message) for x in readers.log_records(spark, str(tmp_path / "log")).collect()) == want
