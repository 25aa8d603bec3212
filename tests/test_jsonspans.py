"""The structural index beside trying every brace in turn."""

import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from callweave.functions import jsonspans
from callweave.operators import verdicts


def straight(text):
    """The definition: the first brace that begins an object."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            return decoder.raw_decode(text, at)[0]
        except ValueError:
            at = text.find("{", at + 1)
    return None


def search(texts):
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    return [jsonspans.first_object(t, f) for t, f in zip(data, jsonspans.spans(data), strict=True)]


TEXTS = [
    "", "{", "}", "{}", "x {} y", 'He said "see {"a": 1}" twice', '"{"a": "}"}', '{"a": {"b": 1}', '{"a" {"b": 1}}', '{"a": {"b": 1} x {"c": 2}}', "{'a': 1} {\"a\": 2}", '\\{"a": "\\"}"}', '{"a": "\\\\"} tail', '{"a": "\\\\\\"}"}',
    '[{"a": 1}]', '{"a": [1, {"b": 2}}', '{"é": "漢字 { "} {"b": 1}', '{"a": "line\nbreak {"} {"c": 3}', "{{{{ {\"x\": []}", '{"a":1,"a":2}', '{"a": NaN}', '{"a": 1,}{"b": 2}', '{"a": ' + "9" * 5000 + '} {"b": 1}', '"\\" {"a": 1}', "\\\\\"{\"k\": \"v\"}", '{"a":}', '{"x": {"y": }} {"z": {}}',
]


@pytest.mark.parametrize("text", TEXTS)
def test_one_text(text):
    assert repr(search([text])[0]) == repr(straight(text))


def test_a_batch_is_its_texts():
    assert list(map(repr, search(TEXTS))) == [repr(straight(t)) for t in TEXTS]
    assert search([]) == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='{}[]":,\\ a1é\n', max_size=40), max_size=4))
def test_random_characters(texts):
    assert list(map(repr, search(texts))) == [repr(straight(t)) for t in texts]


def test_broken_objects():
    r = random.Random(3)

    def value(depth):
        kind = r.randrange(6 if depth else 3)
        if kind < 3:
            return r.choice([1, None, True, "s", 'q"uo\\te{', "}{", "é\n"])
        return [value(depth - 1) for _ in range(r.randrange(3))] if kind == 3 else {r.choice("abc"): value(depth - 1) for _ in range(r.randrange(3))}

    texts = []
    for _ in range(1500):
        text = " ".join(r.choice(["{", '"', "see", json.dumps(value(4)), json.dumps({"k": value(4)}, ensure_ascii=False)]) for _ in range(r.randrange(1, 5)))
        for _ in range(r.randrange(3)):
            i = r.randrange(len(text) + 1)
            text = text[:i] + r.choice(['"', "{", "}", "\\", ",", ""]) + text[i + r.randrange(2) :]
        texts.append(text)
    assert list(map(repr, search(texts))) == [repr(straight(t)) for t in texts]


@pytest.mark.parametrize("piece", ["{", '{"a":', '{"a": {"b": "x"}, ', '"{', '{"a": "', "{[", '\\"{', "{}}{x"])
def test_linear(piece):
    def seconds(n):
        text = ("x " + piece * n).encode()
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            try:
                jsonspans.first_object(text, jsonspans.spans([text])[0])
            except RecursionError:
                pass
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(80_000) < 12 * max(seconds(20_000), 0.004)


def test_nested_and_broken_at_the_core():
    text = ('{"a":' * 400 + "x" + "}" * 400 + ' {"b": 1}') * 20
    began = time.perf_counter()
    assert search([text]) == [{"b": 1}]
    assert time.perf_counter() - began < 2


def test_answers():
    assert verdicts.find_all([None, "", "12", '```json\n{"a": 1}\n```', "``` {\"a\": 2} ```", 'so: ```json {x ``` {"a": 3}', "none"]) == [None, None, 12, {"a": 1}, {"a": 2}, {"a": 3}, None]
    assert verdicts.find_json('```json {"a": 1}') == {"a": 1}
    assert verdicts.find_all(["{" * 100_000, "```" + " " * 200_000 + "{"]) == [None, None]


def test_groups_do_not_matter(monkeypatch):
    whole = verdicts.find_all(TEXTS)
    monkeypatch.setattr(verdicts, "_INDEXED", 30)
    assert list(map(repr, verdicts.find_all(TEXTS))) == list(map(repr, whole))
