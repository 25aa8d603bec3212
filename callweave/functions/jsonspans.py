"""Where JSON objects may stand in free text: a structural index of a whole batch.

The bytes of all texts of a batch are looked at together, by numpy: runs of backslashes say
which quotes are escaped, the running parity of the other quotes says what is inside a
string, and running sums of opening and closing brackets give the depth. An object may
begin inside what looks like a string from the text's start (prose has quotes too), so
both readings are indexed: brackets at an even and at an odd number of quotes.

In one reading an opening bracket's partner is the next bracket of its level. What has no
partner begins no object and is never tried. Where an object that was tried breaks at
some place, every object within it that closes before that place is good, and all others
that began before it break there too. So each reading of a text is parsed once at most.
"""

from __future__ import annotations

import json

import numpy as np

_QUOTE, _ESCAPE, _OPEN, _CLOSE = 34, 92, 123, 125


def spans(texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """For each text the (start, end, reading) of each opening brace with a partner, by start."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    if not len(sizes):
        return out
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    plain = np.maximum.accumulate(np.where(data != _ESCAPE, place, place.dtype.type(-1)))
    before = np.append(place.dtype.type(-1), plain[:-1])  # the last place before that is no backslash
    quotes = np.cumsum((data == _QUOTE) & ((place - 1 - before) % 2 == 0), dtype=place.dtype)
    opens = (data == _OPEN) | (data == 91)
    at = np.flatnonzero(opens | (data == _CLOSE) | (data == 93))
    if not len(at):
        return out
    text = np.searchsorted(begins, at, side="right") - 1
    reading = (quotes[at] - np.where(begins[text] > 0, quotes[begins[text] - 1], 0)) % 2
    opening = opens[at]
    step = np.where(opening, 1, -1)
    key = text * 2 + reading
    order = np.argsort(key, kind="stable")
    depth = np.empty(len(at), np.int64)
    depth[order] = np.cumsum(step[order])  # levels need no common zero: partners are of one text and reading
    level = np.where(opening, depth, depth + 1)
    order = np.lexsort((at, level, key))
    a, b = order[:-1], order[1:]
    pairs = (key[a] == key[b]) & (level[a] == level[b]) & opening[a] & ~opening[b] & (data[at[a]] == _OPEN)
    a, b = a[pairs], b[pairs]
    order = np.argsort(at[a])
    a, b = a[order], b[order]
    for t, i, j, r in zip(text[a].tolist(), at[a].tolist(), at[b].tolist(), reading[a].tolist(), strict=True):
        out[t].append((i - int(begins[t]), j - int(begins[t]) + 1, r))
    return out


def first_object(text: bytes, found: list[tuple[int, int, int]]) -> object | None:
    """The first object in a text that can be decoded, by its spans. Raises RecursionError
    where one that is tried is nested too deeply."""
    broken = [0, 0]  # up to where each reading is known
    for start, end, reading in found:
        if start < broken[reading] < end:
            continue  # open where the one around it broke
        part = text[start:end].decode("utf-8", "surrogatepass")
        try:
            return json.loads(part)
        except json.JSONDecodeError as e:
            broken[reading] = max(broken[reading], start + len(part[: e.pos].encode("utf-8", "surrogatepass")))
        except ValueError:  # a number of too many digits
            continue
    return None
