import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from callweave.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def codec(**leaves):
    with open(PATH, "rb") as f:
        return bpe.TreeCodec(f.read(), P.PATTERN, **leaves)


@pytest.fixture(scope="module")
def small():
    """Tiny leaves, so that short texts already make trees."""
    return codec(leaf_chars=16, leaf_bytes=6)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=codec().ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'sre tl\n\t12.,!é中  "), st.characters(exclude_categories=["Cs"])), max_size=150))
def test_equals_the_library(small, library, text):
    ids = small.encode(text)
    assert ids == library.encode_ordinary(text)
    assert small.decode(ids) == text.encode()


def test_runs_without_a_seam(small, library):
    rng = random.Random(2)
    for _ in range(200):
        run = "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(0, 900)))
        assert small.encode(run) == library.encode_ordinary(run)
    for run in ("a" * 5000, " " * 3000, "!?" * 2000, "ab" * 2500 + "\n" * 999 + "x"):
        assert small.encode(run) == library.encode_ordinary(run)


def test_joins_are_associative(small, library):
    word = b"internationalisation" * 9
    parts = [small._bytes(word[i : i + 7]) for i in range(0, len(word), 7)]
    left = parts[0]
    for p in parts[1:]:
        left = small.join(left, p)
    right = parts[-1]
    for p in parts[-2::-1]:
        right = small.join(p, right)
    assert left == right == library._encode_single_piece(word)


def test_nodes_join_wherever_a_text_is_cut(small, library):
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["ab", " ", "  ", "\n", "\t", "'", "ll", "'re", "7", "é", "!", "\u2003", "word"]) for _ in range(rng.randint(2, 60)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(3))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        node = lambda i: small._leaf(parts[i])
        one = small.join_nodes(small.join_nodes(small.join_nodes(node(0), node(1)), node(2)), node(3))
        two = small.join_nodes(small.join_nodes(node(0), node(1)), small.join_nodes(node(2), node(3)))
        assert one == two and "".join(one[0]) == text
        assert [i for t in one[1] for i in t] == library.encode_ordinary(text)


def test_real_documents_come_through_the_joins(library):
    """All documents, with the leaves that the query has; both joins run, and often."""
    own = codec()
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    for text in texts:
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    assert own.joins["matches"] >= sum(-(-len(t) // bpe.LEAF_CHARS) - 1 for t in texts) > 100
    assert own.joins["tokens"] > 100


def test_columns(spark, library):
    texts = ["hello world", "", None, "x" * 30_000, "a b " * 20_000]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r for r in bpe.round_trip(df, PATH, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode_column(bpe.encode_column(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded) for r in back} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0


def test_long_matches_are_quick_and_equal_the_library(library):
    r, own = random.Random(3), codec()
    n = 60_000
    letters = "abcdefghijklmnopqrstuvwxyz"
    for text in ("-" * n, " " * n, "a" * n, "=" * n, "".join(r.choices(letters, k=n)), "-=" * (n // 2), "abc" * (n // 3), "=-=+" * 5000 + "é" * 3000, "漢" * 20_000, "0" * n):
        began = time.process_time()
        ids = own.encode(text)
        assert time.process_time() - began < 12  # some tenths of this on an idle machine; quadratic merges took a minute
        assert ids == library.encode_ordinary(text)


def test_heap_and_list_give_the_same(monkeypatch):
    r, own = random.Random(8), codec()
    for _ in range(400):
        piece = "".join(r.choices(r.choice(["ab", "the ", "-=", "aeiourstln", "é漢a"]), k=r.randrange(2, 60))).encode()
        monkeypatch.setattr(bpe, "HEAPED", 0)
        heaped = own.merged(piece)
        monkeypatch.setattr(bpe, "HEAPED", 10**9)
        assert heaped == own.merged(piece)


def test_a_new_match_does_not_make_its_leaf_be_looked_up_again(library):
    own, hashed = codec(), []

    class Word(str):
        def __hash__(self):
            hashed.append(str(self))
            return str.__hash__(self)

    text = "the cat sat on the mat with qzxvunseen"
    own.encode("the cat sat on the mat with")
    find = own.matches
    own.matches = lambda text: [Word(m) for m in find(text)]
    assert own.encode(text) == library.encode_ordinary(text)
    assert [hashed.count(m) for m in ("the", " cat", " sat", " on", " the", " mat", " with")] == [1] * 7


def test_long_matches_at_the_rims_of_leaves(small, library):
    for text in ("x" * 70, "x" * 70 + " " + "y" * 80, "-" * 65 + "a" + "=" * 65, "a" + " " * 90, "é" * 200 + "\n" * 100 + "漢" * 70):
        for first in (False, True):
            for last in (False, True):
                found, tokens = small._leaf(text, first, last)
                assert "".join(found) == text and len(tokens) == len(found)
                rims = ({0} if first else set()) | ({len(found) - 1} if last else set())
                assert [t is None for t in tokens] == [i in rims and len(m) > bpe.MEMORABLE for i, m in enumerate(found)]
        assert small.encode(text) == library.encode_ordinary(text)
