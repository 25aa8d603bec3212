import hashlib
import random

import pytest

from callweave.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def pages():
    rng = random.Random(3)
    out = []
    for i in range(700):
        html = rng.choice(["", "x" * 99, "y" * 100, "é" * 50, None]) if i % 5 == 0 else f"page {i // 2 * 2 if i % 7 == 0 else i} " + "lorem é " * rng.randint(5, 90)
        if i % 11 == 0:
            html = (html or "") + "\r\n\r\n" + FAKE + "WARC/1.0\r\n tail" + str(i % 4)
        if i % 13 == 0:
            html = "WARC/1.0\r\n" * 3 + "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 50000\r\n\r\n"
        out.append((i, f"http://a/{i}\r\nx: y" if i % 17 == 0 else f"http://a/{i}", html))
    return out


def expected(rows):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and i is not None:
            first[body] = min(first.get(body, i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        of = first.get(body, i)
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if of == i else "revisit", None if of == i else of))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", ["4k", "64m"])
def test_round_trip(spark, block):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        rows = pages()
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
        assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str) == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_nulls_and_repeats(spark):
    long = "z" * 300
    rows = [(None, None, long), (4, None, long), (4, "u", long), (2, "", None), (None, "u", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int")
    assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str) == expected(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_a_broken_chain_ends(spark, tmp_path):
    good = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    broken = good.format(2).replace("Content-Length: 3", "Content-Length: 4")
    (tmp_path / "a.warc").write_bytes((good.format(1) + broken + good.format(3)).encode())
    (tmp_path / "b.warc").write_bytes(b"no archive at all\r\n" + good.format(4).encode())
    assert {r.page_id for r in warc.read_archive(spark, str(tmp_path)).collect()} == {1, 2}


def test_payloads_with_numbers_that_no_record_can_have(spark):
    fake = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:page:{}>\r\n{}Content-Length: {}\r\n\r\nabc\r\n\r\n"
    rows = [(0, "u", "plain")]
    for number in ("99999999999999999999", str((1 << 63) - 1), "9" * 5000, "1" + "0" * 18):
        for html in (fake.format("response", "7", "", number), fake.format("response", number, "", "3"), "x" + fake.format("revisit", "7", f"X-Payload-Length: {number}\r\n", "0"), fake.format("revisit", "7", f"WARC-Refers-To: <urn:page:-{number}>\r\n", "0")):
            rows.append((len(rows), "u", html))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str) == expected(rows)


def test_long_payloads_in_many_pieces(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        rows = [(i, "u", ("a" * 40_000 + FAKE) * (70 if i % 3 == 0 else 1) + str(i)) for i in range(9)]
        df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
        assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str) == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_revisits_take_size_and_digest_from_their_response(spark, tmp_path):
    body = "q" * 120
    digest = hashlib.sha256(body.encode()).hexdigest()
    head = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:page:{}>\r\n"
    one = head.format("response", 1) + f"Content-Length: 120\r\n\r\n{body}\r\n\r\n"
    two = head.format("revisit", 2) + f"WARC-Refers-To: <urn:page:1>\r\nWARC-Payload-Digest: sha256:{digest}\r\nX-Payload-Length: 5\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    three = head.format("revisit", 3) + "WARC-Refers-To: <urn:page:9>\r\nWARC-Payload-Digest: sha256:ab\r\nX-Payload-Length: 5\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((one + two + three).encode())
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read_archive(spark, str(tmp_path)).collect()} == {(1, 120, digest), (2, 120, digest), (3, 5, "ab")}
