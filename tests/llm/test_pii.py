import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from callweave.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def fits(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if fits(kind, m[0]))


def test_patterns_equal_brute_force():
    rng = random.Random(1)
    for alphabet in ("a@.-+1 0()b%_9@.", "0123456789 -", "12.3.255.", "+1 (2)-.3"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert pii.pattern_spans(text) == brute(text), text
    assert len(pii.pattern_spans("4012 8888-8888 1881 and 😀 a@b.co")) == 2
    assert pii.pattern_spans("9" * 50_000 + "a" * 50_000 + "@") == []


@pytest.fixture(scope="module")
def field():
    return pii.default_field()


def test_field_on_held_out_rows(field):
    hit = extra = missed = 0
    for text, spans in pii.labelled_table(seed=1234, size=300):
        got = {(a, b, pii.KINDS[k]) for a, k, b in pii.field_spans(field, [text])[0]}
        hit, extra, missed = hit + len(got & set(spans)), extra + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + extra) > 0.88 and hit / (hit + missed) > 0.8, (hit, extra, missed)


def test_viterbi_equals_all_paths(field):
    words = pii.Words("call Mr. Tom Berlin now at 12 Holm Street today")
    scores, best = field.emissions(words), field.decode(words)
    first = np.flatnonzero(words.first)
    for start, end in zip(first, [*first[1:], len(best)], strict=True):
        def total(path, start=start):
            return field.begin[path[0]] + sum(scores[start + i, y] for i, y in enumerate(path)) + sum(field.steps[a, b] for a, b in itertools.pairwise(path))
        if end - start <= 5:
            top = max(itertools.product(range(len(pii.LABELS)), repeat=end - start), key=total)
            assert total(tuple(best[start:end])) == pytest.approx(total(top), rel=1e-5)
        for _ in range(200):
            path = tuple(random.Random(_).choices(range(len(pii.LABELS)), k=end - start))
            assert total(path) <= total(tuple(best[start:end])) + 1e-3


def test_batches_do_not_matter(field):
    texts = [t for t, _ in pii.labelled_table(seed=5, size=40)] + ["", "  ", "\n\n", "😀 Mr. Tom Berlin"]
    alone = [pii.field_spans(field, [t])[0] for t in texts]
    assert pii.field_spans(field, texts) == alone


def test_training_repeats():
    table = pii.labelled_table(size=60)
    a, b = pii.train(table, rounds=5), pii.train(table, rounds=5)
    assert (a.near == b.near).all() and (a.steps == b.steps).all()


def test_report_and_mask(spark):
    texts = ["mail a.b@c.de or +1 (212) 555-0100, 10.0.0.1", "", None, "plain prose here", "Dear Mr. Tom Berlin, hello", "x " * 40_000 + "z@y.org"]
    df = spark.createDataFrame([(i, t, len(t or ""), "old") for i, t in enumerate(texts)], "doc_id long, text string, n_chars int, spans string")
    rows = {r.doc_id: r for r in pii.report(df).collect()}
    for i, t in enumerate(texts):
        base = brute(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(pii.line(base).encode()).hexdigest()
        assert not base or set(pii.line(base).split(",")) <= set(rows[i].spans.split(","))
    assert rows[4].spans == "name:9:19"
    out = {r.doc_id: r for r in pii.mask(df).collect()}
    assert pii.mask(df).columns == df.columns
    assert out[0].text == "mail <EMAIL> or <PHONE>, <IP>" and out[0].n_chars == len(out[0].text)
    assert (out[2].text, out[3].text, out[3].n_chars) == (None, texts[3], len(texts[3]))
    assert out[4].text == "Dear Mr. <NAME>, hello"
    assert pii.mask(df.drop("n_chars")).columns == ["doc_id", "text", "spans"]
    assert pii.report(df.limit(0)).count() == 0


def test_long_runs_of_digits():
    assert pii.pattern_spans("0" * 5000 + ".1.1.1") == [(0, 1, 5006)]
    assert pii.pattern_spans("0" * 6000 + "." + "0" * 6000 + ".0.255") == [(0, 1, 12007)]
    assert pii.pattern_spans("1.1.1." + "9" * 6000) == []
    assert pii.pattern_spans("7" * 9000) == []


def plain_viterbi(field, scores):
    """The best score of a whole sentence, step by step."""
    best = field.begin.astype(float) + scores[0]
    for row in scores[1:].astype(float):
        best = (best[:, None] + field.steps).max(0) + row
    return best.max()


def test_long_sentences_are_one_chain(field):
    rng = random.Random(12)
    spice = ["Mr.", "Tom", "Berlin", "12", "Street", "call", "555-123-4567", "no", "Dr.", "address:"]
    for sizes in ((1,), (64,), (65,), (128, 3, 129), (700, 64, 1, 200, 63)):
        lines = [" ".join(rng.choice(spice) if rng.random() < 0.3 else "filler" for _ in range(n)) for n in sizes]
        words = pii.Words("\n".join(x.replace(".", "") for x in lines))
        scores, labels = field.emissions(words), field.decode(words)
        first = np.flatnonzero(words.first)
        assert list(np.diff([*first, len(labels)])) == list(sizes)
        for a, b in zip(first, [*first[1:], len(labels)], strict=True):
            own = labels[a:b]
            got = field.begin[own[0]] + scores[np.arange(a, b), own].sum(dtype=float) + field.steps[own[:-1], own[1:]].sum(dtype=float)
            assert got == pytest.approx(plain_viterbi(field, scores[a:b]), rel=1e-4, abs=1e-2)


def test_names_anywhere_in_a_long_sentence(field):
    for n in (0, 30, 61, 62, 63, 64, 65, 127, 128, 300):
        text = "and " * n + "Dr. Martin Belker said so"
        assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.field_spans(field, [text])[0]] == [("name", "Martin Belker")], n
