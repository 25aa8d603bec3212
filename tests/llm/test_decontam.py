import duckdb
import pytest

from callweave.llm import decontam

ITEM = "A train leaves from Paris to Bonn at 60 km per hour and returns from Bonn at 80 km per hour after 60 minutes"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 0.5, "x") for i, t in enumerate(texts)], "doc_id long, text string, coverage double, item_id string")


def items(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize(
    ("text", "leaks"),
    [
        (ITEM, True),
        ("BEFORE. " + ITEM.upper() + " AFTER", True),
        (ITEM.lower(), True),
        ("BEFORE. " + ITEM.upper().replace("PARIS", "ROME").replace("BONN", "OSLO"), False),  # new names need their case
        ("Before. " + ITEM.upper().replace("PARIS", "Paris").replace("BONN", "Bonn") + " after", True),
        ("Note: " + ITEM.replace("Paris", "Rome").replace("Bonn", "Oslo").replace("60", "45").replace("80", "33") + "!!!", True),
        (ITEM.replace("after 60", "after 99"), True),  # all but the end word for word
        (ITEM.replace("at 60", "at 45").replace("80", "33").replace("after 60", "after 99"), False),  # one value of the item, two of the document
        (ITEM.replace("60", "45").replace("80", "45"), False),  # two values of the item, one of the document
        (ITEM.replace(" and ", " and then "), True),  # an insertion moves the rest
        (ITEM[: len(ITEM) // 2], False),
        ("nothing of the kind", False),
        (None, False),
        ("", False),
        ("word " * 30_000 + ITEM + " word" * 30_000, True),
    ],
)
def test_leaks(spark, text, leaks):
    d, b = docs(spark, [text]), items(spark, [ITEM, None, ""])
    got = decontam.report(d, b).collect()
    assert bool(got) == leaks
    assert decontam.clean(d, b).count() == (0 if leaks else 1)
    assert decontam.clean(d, b).columns == d.columns


ASKED = [
    ("Tom has 5 pens. Tom buys 3 more pens. How many pens does Tom have now?", "Sara has 7 pens. Sara buys 2 more pens. How many pens does Sara have now?", "Sara has 7 pens. Tim buys 2 more pens. How many pens does Ann have now?"),
    ("A car drives 60 kilometers in 2 hours. What is its speed in meters per minute?", "A car drives 45 miles in 3 hours. What is its speed in feet per minute?", "A car drives 45 miles in 45 hours. What is its weight in tons?"),
    ("There are twelve birds on a tree and forty more arrive. How many birds are there in all?", "There are twenty birds on a tree and 50 more arrive. How many birds are there in all?", "There are twelve nests in a bush and forty eggs."),
]


def test_questions_asked_again_with_other_slots(spark):
    """Names at the start of sentences, units without a number before them, number words."""
    d, b = docs(spark, [f"Intro. {x} Outro." for _, again, other in ASKED for x in (again, other)]), items(spark, [a for a, _, _ in ASKED])
    assert {(r.doc_id, r.item_id) for r in decontam.report(d, b).collect()} == {(0, 0), (2, 1), (4, 2)}


def test_a_window_that_all_items_share(spark):
    """Hot windows are no seeds, and items are found nonetheless; long slot values are whole."""
    line = "How many of the {} are left in the end of {}?"
    letter = lambda i: chr(97 + i // 26) + chr(97 + i % 26)  # noqa: E731  words, since w7 is a word and a number
    texts = [f"{line.format('w' + letter(i), 'v' + letter(i))} z{letter(i)} " + " ".join(f"q{letter(i)}x{letter(j)}" for j in range(9)) for i in range(40)] + ["9" * 70_000 + " a b c d e f"]
    d = docs(spark, [texts[7], texts[33] + " more", line.format("a", "b"), texts[40], texts[40][1:]])
    assert {(r.doc_id, r.item_id) for r in decontam.report(d, items(spark, texts)).collect()} == {(0, 7), (1, 33), (3, 40), (4, 40)}


def test_changed_slots_are_counted(spark):
    text = ITEM.replace("Paris", "Rome").replace("60", "45")
    [r] = decontam.report(docs(spark, [text]), items(spark, [ITEM])).collect()
    assert (r.coverage, r.n_slots, r.n_changed) == (1.0, 7, 2)  # paris, bonn, 60, km, hour, 80 and minutes: units are slots wherever they stand


def test_short_items_and_odd_tables(spark):
    b = items(spark, ["one two", "a"])
    d = docs(spark, ["x one two y", "one and two", "b a", None])
    assert {(r.doc_id, r.item_id) for r in decontam.report(d, b).collect()} == {(0, 0), (2, 1)}
    assert decontam.report(d, items(spark, [])).count() == 0
    assert decontam.report(d.limit(0), b).count() == 0
    assert decontam.clean(d, items(spark, [])).count() == 4


def test_repeated_and_missing_ids(spark):
    d = spark.createDataFrame([(None, ITEM), (None, "fine"), (1, ITEM), (1, ITEM), (1, "fine too")], "doc_id long, text string")
    b = items(spark, [ITEM])
    assert sorted((r.doc_id for r in decontam.report(d, b).collect()), key=str) == [1, None]
    assert sorted(r.text for r in decontam.clean(d, b).collect()) == ["fine", "fine too"]


def test_the_shuffled_join_gives_the_same(spark, monkeypatch):
    d = docs(spark, [ITEM, "clean", ITEM.replace("60", "45")])
    b = items(spark, [ITEM])
    want = sorted(map(tuple, decontam.report(d, b).collect()))
    monkeypatch.setattr(decontam, "small_enough", lambda *_: False)
    assert sorted(map(tuple, decontam.report(d, b).collect())) == want
    assert {r.text for r in decontam.clean(d, b).collect()} == {"clean"}


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(c.execute(f"SELECT doc_id, item_id, coverage, n_slots, n_changed FROM ({decontam.oracle_sql()})").fetchall())
    got = decontam.report(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert sorted((r.doc_id, r.item_id, r.coverage, r.n_slots, r.n_changed) for r in got.collect()) == want and want
