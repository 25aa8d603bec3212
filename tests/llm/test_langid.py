import math
import random
import re
import zlib

import pytest

from callweave.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def model(spark):
    rows = [("the cat and the dog", "en"), ("the house and a tree", "en"), ("der hund und die katze", "de"), ("das haus und ein baum", "de"), (None, "fr"), ("le chat", None)]
    return langid.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_words_first_then_grams(model):
    assert model.languages == ["de", "en"]
    s = langid.Scorer(model)
    assert "the" in model.words and "xthe" not in model.words
    assert s.predict("the and the")[0] == "en" and s.predict("und und")[0] == "de"
    # an unseen word takes the mean of its longest known n-grams
    longest = max(n for n in range(1, 6) if any(g in model.grams for g in langid.grams_of("undx", n)))
    known = [model.gram_rows[model.grams[g]] for g in langid.grams_of("undx", longest) if g in model.grams]
    assert s.backoff(["undx"])[0] == pytest.approx([sum(x) / len(known) for x in zip(*known, strict=True)], rel=1e-5)


def test_small_memory_gives_the_same(model, monkeypatch):
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}und" for i in range(600))
    want = langid.Scorer(model).predict(text)
    monkeypatch.setattr(langid, "REMEMBERED", 20)
    got = langid.Scorer(model).predict(text)
    assert got[0] == want[0] and got[1] == pytest.approx(want[1], rel=1e-5)


def test_edges(spark, model):
    texts = [None, "", "123 !!", "THE", "the " * 50_000]
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(texts)], "doc_id long, text string, score int, lang_pred string")
    rows = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    assert rows[0] == rows[1] == rows[2] == ("und", 0.0)
    assert rows[3][0] == rows[4][0] == "en"
    assert langid.predict(df.limit(0), model).count() == 0


def test_no_labels_and_no_ids(spark):
    df = spark.createDataFrame([(None, "hello there", None), (5, None, "en"), (6, "x", None)], "doc_id long, text string, lang string")
    rows = langid.identify(df).collect()
    assert {r.lang_pred for r in rows} == {"und"}
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert langid.identify(df.limit(0)).count() == 0


def test_only_texts_without_language_are_rejected(spark):
    rows = [(i, "the cat and the dog", "en", 1) for i in range(9)] + [(90, None, "en", 0), (91, "12 34", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(9))


def test_every_word_of_the_sample_is_learned(spark):
    """More words and n-grams than any former limit allowed, and a tie between languages."""
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    words = [name() for _ in range(120_000)]
    rows = [(" ".join(words[i::40] * 2), "ab"[i % 2]) for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert set(model.words) == set(words) and len(model.grams) > 150_000
    tie = langid.fit(spark.createDataFrame([("same same", "b"), ("same same", "a")], "text string, lang string"))
    assert langid.Scorer(tie).predict("same") == ("a", pytest.approx(0.5))


def slow_prediction(train, text):
    """The best language by the rule, word by word and without any table of the module."""
    languages = sorted({lang for _, lang in train})
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    seen = {lang: [w for t, own in train if own == lang for w in words(t)] for lang in languages}
    parts = {lang: [g for w in seen[lang] for n in range(1, langid.LONGEST + 1) for g in langid.grams_of(w, n)] for lang in languages}

    def shares(token, pool):
        times = [pool[lang].count(token) for lang in languages]
        if sum(times) < langid.LEAST:
            return None
        freq = [(t + 0.05) / (len(pool[lang]) + 1) for t, lang in zip(times, languages, strict=True)]
        return [max(-7.0, math.log(f / sum(freq))) for f in freq]

    total, found = [0.0] * len(languages), words(text)
    for w in found:
        own = shares(w, seen)
        for n in range(langid.LONGEST, 0, -1):
            if own is None and (known := [x for g in langid.grams_of(w, n) if (x := shares(g, parts))]):
                own = [sum(x) / len(known) for x in zip(*known, strict=True)]
        for i, x in enumerate(own or [-math.log(len(languages))] * len(languages)):
            total[i] += x
    if not found:
        return "und", 0.0
    best = max(range(len(languages)), key=lambda i: (total[i], -i))
    return languages[best], min(1.0, math.exp(total[best] / len(found)))


def test_predictions_equal_brute_force(spark):
    rng = random.Random(9)
    alphabet = {"x": "abcdé", "y": "cdefß", "z": "aehß"}
    text = lambda lang: " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12)))
    train = [(text(lang), lang) for lang in "xyz" for _ in range(5)]
    scorer = langid.Scorer(langid.fit(spark.createDataFrame(train, "text string, lang string")))
    for _ in range(80):
        t = text(rng.choice("xyz")) + rng.choice(["", " 42!", " ÉCOLE q_w"])
        want, got = slow_prediction(train, t), scorer.predict(t)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], rel=1e-4)
