"""Byte-level BPE encoding and decoding by tree reduction.

A text is halved until the parts are short, wherever that cuts it. A part is a node: its
matches of the pattern and the tokens of each. Neighbours are joined upwards by encoding a
window around the cut anew, which doubles until what lies outside provably cannot change:

1. Matches. Matching looks at no character before its start, so parts that agree on a
   boundary agree on all that follows. Between a letter or digit and a following blank or
   line feed every parse has a boundary, and no match or look-ahead reaches across it. A
   window of matches is wide enough once both its rims are such places (or the part's end).
2. Tokens. A match that is long is halved too, at any byte. A token sequence is the
   encoding of its bytes if, and only if, each two adjacent tokens are the encoding of
   their joint bytes. A window of tokens is wide enough once the tokens on both its rims
   fit their neighbours outside.

Leaves are encoded by merging the pair of least rank first. Both joins are associative, so
the result does not depend on where a text is cut. Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches, kept

#: Characters of a leaf of the tree over a text; bytes of a leaf inside a match; token ids of a leaf in decoding.
LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 1024, 16, 8192
#: Matches whose tokens a worker remembers, and the length up to which it does.
REMEMBERED, MEMORABLE = 400_000, 64
#: Bytes from which on pairs are kept in a heap; below, looking at all of them is quicker.
HEAPED = 48
#: Stands for the rank of a pair that has none.
_NONE = 1 << 40

Node = tuple[list[str], list[tuple[int, ...] | None]]  # matches and the tokens of each; None for a long one at a rim, which may not be whole


class Remembered(dict):
    """Tokens by match; those of a match that is not there are made as it is looked up."""

    def __init__(self, make: Callable[[str], tuple[int, ...]]):
        self.make = make

    def __missing__(self, match: str) -> tuple[int, ...]:
        return self.make(match)


class TreeCodec:
    """Encoder and decoder for one rank file and one pattern, whose matches cover any text."""

    def __init__(self, rank_file: bytes, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.matches = regex.compile(pattern).findall
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self.fits = lru_cache(1 << 16)(self._fits)
        self.remembered = Remembered(self.tokens)
        self.pair_ranks = [self.ranks.get(bytes(divmod(i, 256)), _NONE) for i in range(1 << 16)]
        self.joins = {"matches": 0, "tokens": 0}  # joins made so far, for tests and figures

    def encode(self, text: str) -> list[int]:
        """Token ids of text, each match of the pattern encoded separately."""
        matches, tokens = self._node(text, 0, len(text))
        if None in tokens:
            tokens = [self.tokens(m) if t is None else t for m, t in zip(matches, tokens, strict=True)]
        return list(chain.from_iterable(tokens))

    # ------------------------------------------------ the tree over a text

    def _node(self, text: str, lo: int, hi: int) -> Node:
        if hi - lo <= self.leaf_chars:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join_nodes(self._node(text, lo, mid), self._node(text, mid, hi))

    def _leaf(self, text: str, first: bool = True, last: bool = True) -> Node:
        """Matches of a text and their tokens; first and last say whether its rims are a node's.

        A long match at a node's rim goes on in the next node as likely as not, so it is
        encoded when it is whole, once.
        """
        found = self.matches(text)
        if not found:
            return found, []
        head, tail = first and len(found[0]) > MEMORABLE, last and len(found[-1]) > MEMORABLE
        if not head and not tail:
            return found, list(map(self.remembered.__getitem__, found))
        lo, hi = int(head), max(int(head), len(found) - tail)
        return found, [None] * lo + list(map(self.remembered.__getitem__, found[lo:hi])) + [None] * (len(found) - hi)

    def join_nodes(self, left: Node, right: Node) -> Node:
        """The node of two neighbouring texts; left is used up."""
        (a, ta), (b, tb) = left, right
        if not a or not b:
            return left if a else right
        self.joins["matches"] += 1
        width = 1
        while True:
            i, j = max(0, len(a) - width), min(len(b), width)
            if (i == 0 or self._parted(a[i - 1], a[i])) and (j == len(b) or self._parted(b[j - 1], b[j])):
                break
            width *= 2
        found, tokens = self._leaf("".join(a[i:] + b[:j]), i == 0, j == len(b))
        a[i:], ta[i:] = found, tokens
        a.extend(b[j:])
        ta.extend(tb[j:])
        return a, ta

    @staticmethod
    def _parted(before: str, after: str) -> bool:
        """Whether a boundary between these stands in every parse."""
        return after[0] in " \n" and before[-1].isalnum()

    # ------------------------------------------------ the tree over a match

    def tokens(self, match: str) -> tuple[int, ...]:
        """Tokens of one match: itself if it has a rank, else by merges."""
        own = match.encode()
        out = (self.ranks[own],) if own in self.ranks else tuple(self._bytes(own))
        if len(match) <= MEMORABLE:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            self.remembered[match] = out
        return out

    def _bytes(self, piece: bytes, known: dict[bytes, list[int]] | None = None) -> list[int]:
        """The encoding of a part of a match. Equal parts of it, as in a ruled line, whose joins
        never stabilise, are encoded once."""
        if len(piece) <= self.leaf_bytes:
            return self.merged(piece)
        known = {} if known is None else known
        if piece not in known:
            half = len(piece) // 2
            known[piece] = self.join(self._bytes(piece[:half], known), self._bytes(piece[half:], known))
        return known[piece]

    def merged(self, piece: bytes) -> list[int]:
        """The encoding of some bytes: the leftmost pair of least rank is merged until none has a rank."""
        if len(piece) > HEAPED:
            return self._heaped(piece)
        get, ranks = self.ranks.get, self.pair_ranks
        starts = list(range(len(piece) + 1))  # where each part starts, and the end
        pairs = [ranks[a << 8 | b] for a, b in pairwise(piece)]  # rank of each part with the next
        while pairs and (least := min(pairs)) != _NONE:
            i = pairs.index(least)
            del pairs[i], starts[i + 1]
            if i < len(pairs):
                pairs[i] = get(piece[starts[i] : starts[i + 2]], _NONE)
            if i:
                pairs[i - 1] = get(piece[starts[i - 1] : starts[i + 1]], _NONE)
        return [self.ranks[piece[a:b]] for a, b in pairwise(starts)]

    def _heaped(self, piece: bytes) -> list[int]:
        """The same for many bytes, in n log n steps: pairs in a heap, parts by their ends."""
        get, n = self.ranks.get, len(piece)
        ends, before = list(range(1, n + 1)), list(range(-1, n))  # where a part ends, 0 once it is merged; the part before a place
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != end:
                continue  # one of its parts has been merged since
            ends[i], ends[middle], before[end] = end, 0, i
            if end < n and (rank := get(piece[i : ends[end]])) is not None:
                heappush(heap, (rank, i, ends[end]))
            if i and (rank := get(piece[before[i] : end])) is not None:
                heappush(heap, (rank, before[i], end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of left and right, two neighbouring parts of one match."""
        if not left or not right:
            return left or right
        self.joins["tokens"] += 1
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.fits(left[i - 1], window[0])) and (j == len(right) or self.fits(window[-1], right[j])):
                return left[:i] + window + right[j:]
            width *= 2 if width < 64 else 8

    def _fits(self, a: int, b: int) -> bool:
        return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    # ------------------------------------------------ decoding

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, concatenated up the tree."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def codec(rank_file: bytes, pattern: str) -> TreeCodec:
    """One codec for each rank file and Python worker, until the worker does something else."""
    return kept(("codec", hashlib.sha256(rank_file).hexdigest(), pattern), lambda: TreeCodec(rank_file, pattern))


def _mapped(df: DataFrame, column: str, path: str, pattern: str, fields: str, make) -> DataFrame:
    """df with further columns that make(codec, values) gives for a batch's column."""
    bounded_batches(df.sparkSession)
    with open(path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    names = [c for c in df.columns if c not in {x.split()[0] for x in fields.split(", ")}]
    df = df.select(*[df[f"`{c}`"] for c in names])
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for batch in batches:
            made = make(own, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], names=[*names, *made])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{ddl}, {fields}")


def encode_column(df: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """df and token_ids array<int> of a text column; a null text counts as empty.

    A column of df that is called token_ids is replaced. path names a rank file that
    the driver can read; it is sent to the executors once (about 1 MB).
    """

    def make(own: TreeCodec, values: list) -> dict:
        return {"token_ids": pa.array([own.encode(v or "") for v in values], pa.list_(pa.int32()))}

    return _mapped(df, column, path, pattern, "token_ids array<int>", make)


def decode_column(df: DataFrame, path: str, pattern: str, column: str = "token_ids") -> DataFrame:
    """df and decoded (binary) of a column of token ids; null ids count as none."""

    def make(own: TreeCodec, values: list) -> dict:
        return {"decoded": pa.array([own.decode(v or []) for v in values], pa.binary())}

    return _mapped(df, column, path, pattern, "decoded binary", make)


def round_trip(df: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """df and, per row, n_tokens, ids_sha256 and decoded_sha256 of a text column.

    Encodes and decodes in one pass, so that ids and decoded bytes need not leave
    the worker. ids are hashed as little-endian unsigned 32-bit integers. Null and
    empty texts give no tokens and the digest of no bytes.
    """

    def make(own: TreeCodec, values: list) -> dict:
        rows = []
        for v in values:
            ids = own.encode(v or "")
            rows.append((len(ids), hashlib.sha256(np.fromiter(ids, "<u4", len(ids))).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
        n, ids, decoded = zip(*rows) if rows else ((), (), ())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

    return _mapped(df, column, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
