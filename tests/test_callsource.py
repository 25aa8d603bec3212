import datetime
import random

import pytest
from pyspark.sql import functions as F

from callweave.sources import callsource

D = datetime.date


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(5)
    rows = [(f"c{i:04}", D(2024, 1, 1) + datetime.timedelta(days=min(r.randrange(120), r.randrange(120))), r.randrange(4), i) for i in range(900)]
    rows += [(f"d{i:03}", D(2024, 2, 29), 9, i) for i in range(60)] + [("c0001", D(2024, 1, 1), 1, -1), ("n", None, 1, 1)]
    df = spark.createDataFrame(rows, "id string, day date, agent_id long, flight_request_id long")
    df = df.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in callsource.RECORD.split(", ")) if n not in df.columns])
    path = str(tmp_path_factory.mktemp("calls") / "store")
    callsource.write_folder(df, path)
    callsource.register(spark)
    return path, rows


def read(spark, path, **options):
    return spark.read.format("calls").option("path", path).options(**options).load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_everything_once(spark, folder):
    path, rows = folder
    got = read(spark, path).collect()
    assert sorted(r.id for r in got if r.id != "c0001") == sorted(r[0] for r in rows if r[1] and r[0] != "c0001")
    assert not any(r.truncated for r in got)


def test_days_and_agents_are_pushed(spark, folder):
    path, rows = folder
    df = read(spark, path).where((F.col("day") >= D(2024, 1, 20)) & (F.col("day") < D(2024, 3, 3)) & F.col("agent_id").isin(1, 3) & (F.col("flight_request_id") > 100))
    assert ids(df) == sorted(r[0] for r in rows if r[1] and D(2024, 1, 20) <= r[1] < D(2024, 3, 3) and r[2] in (1, 3) and r[3] > 100)
    text = plan(df)
    filters = text[text.index("Filter") : text.index("BatchScan")]
    assert "flight_request_id" in filters and "day" not in filters.replace("isnotnull(day", "") and "agent_id" not in filters.replace("isnotnull(agent_id", "")


@pytest.mark.parametrize("where, test", [
    ("day = DATE '2024-02-29'", lambda d, a: d == D(2024, 2, 29)),
    ("day > DATE '2024-03-01' AND day <= DATE '2024-03-05' AND agent_id = 2", lambda d, a: D(2024, 3, 1) < d <= D(2024, 3, 5) and a == 2),
    ("agent_id = 1 AND agent_id = 2", lambda d, a: False),
    ("agent_id = 77", lambda d, a: False),
    ("day = DATE '1999-01-01'", lambda d, a: False),
    ("day >= DATE '2024-02-01' AND day < DATE '2024-02-01'", lambda d, a: False),
    ("agent_id = 9 OR day = DATE '2024-01-03'", lambda d, a: a == 9 or d == D(2024, 1, 3)),
    ("year(day) = 2024 AND month(day) = 2", lambda d, a: (d.year, d.month) == (2024, 2)),
])
def test_filters(spark, folder, where, test):
    path, rows = folder
    assert ids(read(spark, path).where(where)) == sorted(r[0] for r in rows if r[1] and test(r[1], r[2]))


def test_a_full_range_is_halved_and_a_full_day_is_marked(spark, folder):
    path, rows = folder
    got = read(spark, path, limit="50").collect()
    by = {}
    for i, d, *_ in rows:
        if d:
            by.setdefault(d, set()).add(i)
    for d, own in by.items():
        back = {(r.id, r.truncated) for r in got if r.day == d}
        if len(own) < 50:
            assert {i for i, _ in back} | {"c0001"} == own | {"c0001"} and not any(t for _, t in back)
        else:
            assert back == {(i, True) for i in sorted(own)[:50]}
    assert sum(len(x) >= 50 for x in by.values()) == 1


def test_searches_of_a_range(folder):
    calls = []

    class Service:
        def search(self, first, last, agent, limit):
            import pyarrow as pa

            calls.append((first, last))
            n = min(limit, 3 * ((last - first).days + 1))
            return pa.table({"id": [f"{first}{i}" for i in range(n)]})

    parts = list(callsource.halved(Service(), D(2024, 1, 1), D(2024, 1, 8), None, 10))
    assert [t.num_rows for t, _ in parts] == [6] * 4 and not any(cut for _, cut in parts)
    assert len(calls) == 7
    parts = list(callsource.halved(Service(), D(2024, 1, 1), D(2024, 1, 8), None, 10, depth=1))
    assert [(t.num_rows, cut) for t, cut in parts] == [(10, True)] * 2


def test_ranges_are_planned_without_reading(folder):
    reader = callsource._Reader({"path": folder[0]})
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts][0] == (D(2024, 1, 1), D(2024, 2, 1)) and parts[-1].last == D(2024, 4, 30) and all((p.last - p.first).days < 32 for p in parts)


def test_empty_folder(spark, tmp_path):
    callsource.register(spark)
    assert read(spark, str(tmp_path / "none")).count() == 0
    assert read(spark, str(tmp_path / "none")).where("day = DATE '2024-01-01'").count() == 0
