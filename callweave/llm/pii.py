"""Personal data by patterns and by a linear-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card numbers and international telephone
numbers; those spans always stay. A conditional random field over word shapes adds
names, street addresses, national telephone numbers and identity numbers, which have no
sure pattern but a typical shape and company. It is trained by gradient ascent from a
small labelled table (one is built from templates; any other can be given), and decodes
batches of sentences by Viterbi in numpy: all sentences of a batch take each step
together.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

BASE = ("email", "ip", "card", "phone")
LEARNED = ("name", "address", "localphone", "idnumber")
KINDS = BASE + LEARNED

# ---------------------------------------------------------------- patterns

_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a start inside a number never helps
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # start, index in KINDS, end


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def pattern_spans(text: str) -> list[Span]:
    """Spans of the patterns, leftmost and non-overlapping for each kind, in order."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _AFTER_AT.match(text, at)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    out.sort()
    return out


# ---------------------------------------------------------------- words and shapes

LABELS = ["O", *(f"{p}-{k}" for k in LEARNED for p in "BI")]
#: Words that tell what stands beside them.
CUES = (
    "mr mrs ms miss dr prof sir madam herr frau monsieur madame senor senora name named called patient contact signed dear "
    "street avenue road lane drive boulevard court square strasse rue calle address lives resident apartment suite "
    "phone telephone tel mobile cell fax call dial ssn social security passport identity licence license number no id born "
    "version page chapter section room item order year isbn apache mit gnu"
).split()
SEGMENT = 64  # words of a sentence that are decoded in one run; longer ones are chained exactly

_SPACE, _LOWER, _UPPER, _NUMBER, _DOT, _DASH, _AT, _ROUND, _PLUS, _STOP, _OTHER = range(11)
_POWERS = np.array([pow(1_000_003, i, 1 << 64) for i in range(17)], np.uint64)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point of the basic plane; a further one counts as other."""
    out = np.full(0x10001, _OTHER, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if c.isspace():
            out[i] = _SPACE
        elif c.isalpha():
            out[i] = _UPPER if c.isupper() else _LOWER
        elif "0" <= c <= "9":
            out[i] = _NUMBER
    for chars, kind in ((".", _DOT), ("-", _DASH), ("@", _AT), ("()", _ROUND), ("+", _PLUS), (",;:!?", _STOP)):
        for c in chars:
            out[ord(c)] = kind
    return out


def _hash(word: str) -> int:
    return sum(ord(c) * int(_POWERS[i]) for i, c in enumerate(word)) % (1 << 64)


_CUE_HASH, _CUE_ID = (np.array(x) for x in zip(*sorted((_hash(w), i + 1) for i, w in enumerate(CUES)), strict=True))
_CUE_HASH = _CUE_HASH.astype(np.uint64)
_TITLES = np.array([CUES.index(w) + 1 for w in ("mr", "mrs", "ms", "dr", "prof")])

#: Sizes of the features of a word: set of classes, length, digits, cue, what follows it.
SIZES = (1 << 10, 8, 12, len(CUES) + 1, 3)


class Words:
    """The words of a text as arrays: bounds, features and sentences."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _classes()[np.minimum(points, 0x10000)]
        solid = np.concatenate(([False], kinds != _SPACE, [False]))
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        n = len(self.start)
        if not n:
            self.features = np.zeros((0, len(SIZES)), np.int32)
            self.first = np.zeros(0, bool)
            return
        # what follows a word's core: nothing, the end of a sentence, other marks
        tail = np.zeros(n, np.int32)
        for _ in range(3):
            last = kinds[self.end - 1]
            strip = ((last == _DOT) | (last == _STOP)) & (self.end - self.start > 1)
            ends = strip & ((last == _DOT) | np.isin(points[self.end - 1], [33, 63]))
            tail = np.where(ends, 1, np.where(strip & (tail == 0), 2, tail))
            self.end = self.end - strip
        line = np.concatenate(([0], np.cumsum(points == 10)))
        bits = np.where(kinds == _SPACE, 0, 1 << (kinds.astype(np.int32) - 1))
        # sums over the core alone: reduceat over core and rest in turn
        cuts = np.stack((self.start, self.end), 1).ravel()
        cuts = cuts[:-1] if cuts[-1] == len(points) else cuts
        mask = np.bitwise_or.reduceat(bits, cuts)[::2]
        digits = np.add.reduceat((kinds == _NUMBER).astype(np.int32), cuts)[::2]
        size = self.end - self.start
        place = np.arange(len(points)) - np.repeat(self.start, np.diff(np.append(self.start, len(points)))) if self.start[0] == 0 else self._places(len(points))
        lower = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint64)
        with np.errstate(over="ignore"):
            hashed = np.add.reduceat(lower * _POWERS[np.minimum(place, 16)], cuts)[::2]
        found = np.minimum(np.searchsorted(_CUE_HASH, hashed), len(_CUE_HASH) - 1)
        cue = np.where((_CUE_HASH[found] == hashed) & (size <= 14), _CUE_ID[found], 0)
        buckets = np.searchsorted([1, 2, 3, 4, 6, 8, 12], size, side="left")
        self.features = np.stack((mask, buckets, np.minimum(digits, 11), cue, tail), 1).astype(np.int32)
        stops = (tail == 1) & ~np.isin(cue, _TITLES)
        begins = np.concatenate(([True], stops[:-1] | (line[self.start[1:]] != line[self.start[:-1]])))
        self.first = begins

    def _places(self, n: int) -> np.ndarray:
        starts = np.append(0, self.start)
        return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


# ---------------------------------------------------------------- the random field


class Field:
    """Weights of a linear-chain random field: features of a word and its neighbours."""

    def __init__(self, seed_weights: np.ndarray | None = None):
        self.offsets = np.concatenate(([0], np.cumsum(SIZES)))
        self.near = np.zeros((3, self.offsets[-1] + 1, len(LABELS)), np.float32) if seed_weights is None else seed_weights
        self.steps = np.zeros((len(LABELS), len(LABELS)), np.float32)
        self.begin = np.zeros(len(LABELS), np.float32)

    def rows(self, features: np.ndarray) -> np.ndarray:
        """Indices of a word's features in the weight tables."""
        return features + self.offsets[:-1]

    def emissions(self, words: Words) -> np.ndarray:
        """Scores (words, labels); a sentence's edge has a feature of its own."""
        kinds, which = np.unique(words.features, axis=0, return_inverse=True)
        which = which.ravel()
        rows = self.rows(kinds)
        before, own, after = (self.near[i][rows].sum(1) for i in range(3))
        edge = self.offsets[-1]
        out = own[which]
        inner = ~words.first[1:]
        out[1:] += np.where(inner[:, None], before[which[:-1]], self.near[0][edge])
        out[:-1] += np.where(inner[:, None], after[which[1:]], self.near[2][edge])
        out[0] += self.near[0][edge]
        out[-1] += self.near[2][edge]
        return out

    def decode(self, words: Words) -> np.ndarray:
        """The best label of each word.

        Sentences are cut into segments of SEGMENT words, and all segments take each step
        together. Of a sentence of several segments, each segment gives the best score from
        every label before it to every label at its end (Viterbi is associative); these are
        chained from left to right and followed back from right to left, which fixes the
        labels at the ends of segments. Then each segment is decoded between its fixed ends.
        """
        n = len(words.start)
        if not n:
            return np.zeros(0, np.int8)
        scores = self.emissions(words)
        since = np.arange(n) - np.maximum.accumulate(np.where(words.first, np.arange(n), 0))
        cut = np.flatnonzero(since % SEGMENT == 0)
        size = np.diff(np.append(cut, n))
        new = words.first[cut]  # whether a segment begins its sentence
        y = len(LABELS)
        enter = np.where(new, -1, 0)  # label before a segment; -1: none, the sentence begins
        leave = np.full(len(cut), -1)  # label at its end; -1: free
        chained = np.flatnonzero(~new | np.append(~new[1:], False))
        if len(chained):
            through = self._through(scores, cut[chained], size[chained], new[chained])
            best, back = np.zeros((len(chained), y)), np.zeros((len(chained), y), np.int64)
            begins = np.flatnonzero(new[chained])
            rank = np.arange(len(chained)) - begins[np.searchsorted(begins, np.arange(len(chained)), side="right") - 1]
            order = np.argsort(rank, kind="stable")
            bounds = np.searchsorted(rank[order], np.arange(rank.max() + 2))
            for a, b in itertools.pairwise(bounds.tolist()):  # the first segments of all, the second ones, ..
                at = order[a:b]
                paths = through[at] if not rank[at[0]] else best[at - 1][:, :, None] + through[at]
                back[at], best[at] = paths.argmax(1), paths.max(1)
            last = np.append(rank[1:] == 0, True)
            for a, b in reversed(list(itertools.pairwise(bounds.tolist()))):
                at = order[a:b]
                nxt = np.minimum(at + 1, len(chained) - 1)
                leave[chained[at]] = np.where(last[at], best[at].argmax(1), enter[chained[nxt]])
                enter[chained[at]] = np.where(rank[at] > 0, back[at, leave[chained[at]]], -1)
        return self._between(scores, cut, size, enter, leave)

    def _through(self, scores: np.ndarray, begin: np.ndarray, size: np.ndarray, new: np.ndarray) -> np.ndarray:
        """(segments, label before, label at the end): best scores; a sentence's first
        segment has the same from each label, as there is none before."""
        first = np.where(new[:, None, None], self.begin[None, None, :], self.steps[None])
        best = first + scores[begin][:, None, :]
        for t in range(1, size.max()):
            live = size > t
            best[live] = (best[live][:, :, :, None] + self.steps[None, None]).max(2) + scores[begin[live] + t][:, None, :]
        return best

    def _between(self, scores: np.ndarray, begin: np.ndarray, size: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
        """Labels of all words by Viterbi in each segment, between its fixed ends."""
        order = np.argsort(-size, kind="stable")
        begin, size, enter, leave = begin[order], size[order], enter[order], leave[order]
        active = [int(np.searchsorted(-size, -t, side="left")) for t in range(size[0] + 1)]  # segments longer than t
        best = scores[begin] + np.where((enter < 0)[:, None], self.begin, self.steps[enter])
        back = []
        final = np.zeros(len(begin), np.int8)
        for t in range(1, size[0] + 1):
            live = active[t]
            ended = slice(live, active[t - 1])
            final[ended] = np.where(leave[ended] < 0, best[ended].argmax(1), leave[ended])
            if not live:
                break
            through = best[:live, :, None] + self.steps[None]
            back.append(through.argmax(1).astype(np.int8))
            best = np.take_along_axis(through, back[-1][:, None, :].astype(np.int64), 1)[:, 0] + scores[begin[:live] + t]
        labels = np.zeros(len(scores), np.int8)
        now = final.copy()
        for t in range(size[0] - 1, -1, -1):
            live = active[t]
            labels[begin[:live] + t] = now[:live]
            if t:
                now[:live] = np.take_along_axis(back[t - 1], now[:live, None].astype(np.int64), 1)[:, 0]
        return labels


def train(table: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 80, rate: float = 0.15, ridge: float = 2e-3) -> Field:
    """A field from a labelled table: texts of one sentence and their spans (start, end, kind).

    Maximises the penalised conditional likelihood by Adam steps over the whole table,
    with forward and backward sums in numpy; the same table gives the same field.
    """
    field = Field()
    sentences = []
    for text, spans in table:
        words = Words(text)
        if not len(words.start):
            continue
        labels = np.zeros(len(words.start), np.int64)
        for start, end, kind in spans:
            inside = np.flatnonzero((words.start < end) & (words.end > start))
            labels[inside] = LABELS.index(f"I-{kind}")
            labels[inside[0]] = LABELS.index(f"B-{kind}")
        sentences.append((field.rows(words.features), labels))
    longest, edge, y = max(len(labels) for _, labels in sentences), field.offsets[-1], len(LABELS)
    count, width = len(sentences), len(SIZES)
    rows = np.full((count, longest + 2, width), -1, np.int64)
    gold, real = np.zeros((count, longest), np.int64), np.zeros((count, longest), bool)
    for i, (r, labels) in enumerate(sentences):
        rows[i, 1 : len(labels) + 1] = r
        rows[i, [0, len(labels) + 1], 0] = edge
        gold[i, : len(labels)], real[i, : len(labels)] = labels, True
    sides = [rows[:, i : i + longest] for i in range(3)]
    near, steps, begin = np.zeros((3, edge + 2, y)), np.zeros((y, y)), np.zeros(y)
    params = [near, steps, begin]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    hot = np.eye(y)[gold] * real[:, :, None]
    pairs = real[:, 1:]
    for k in range(1, rounds + 1):
        scores = sum(near[i][sides[i]].sum(2) for i in range(3))
        ahead, behind = np.zeros((count, longest, y)), np.zeros((count, longest, y))
        ahead[:, 0] = scores[:, 0] + begin
        for t in range(1, longest):
            ahead[:, t] = np.where(real[:, t, None], scores[:, t] + _lse(ahead[:, t - 1, :, None] + steps, 1), ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(real[:, t + 1, None], _lse(steps + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
        whole = _lse(ahead[:, -1], 1)
        share = np.exp(ahead + behind - whole[:, None, None]) * real[:, :, None]
        both = np.exp(ahead[:, :-1, :, None] + steps + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * pairs[:, :, None, None]
        gap = hot - share
        grads = [np.zeros_like(near), np.zeros_like(steps), gap[:, 0].sum(0)]
        for i in range(3):
            for f in range(width):
                np.add.at(grads[0][i], sides[i][:, :, f], gap)
        grads[0][:, -1] = 0  # the row of absent features
        grads[1] += np.einsum("stc,std->cd", hot[:, :-1] * pairs[:, :, None], hot[:, 1:]) - both.sum((0, 1))
        for p, g, m, s in zip(params, grads, means, squares, strict=True):
            g = g / count - ridge * p
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p += rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
        near[:, -1] = 0
    field.near, field.steps, field.begin = near[:, :-1].astype(np.float32), steps.astype(np.float32), begin.astype(np.float32)
    return field


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def labelled_table(seed: int = 7, size: int = 900) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """A small labelled table, drawn from templates with invented fillers."""
    rng = random.Random(seed)
    syllables = "an ber cor dan el fin gar hol in jo kel lu mar nor ol per quin ros sal tor ur vel wil".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    name = lambda: word().capitalize()
    number = lambda shape: "".join(rng.choice("0123456789") if c == "#" else c for c in shape)
    prose = lambda lo, hi: " ".join(word() if rng.random() > 0.08 else name() for _ in range(rng.randint(lo, hi)))
    fill = {
        "name": lambda: " ".join(name() for _ in range(rng.choice((1, 2, 2, 3)))),
        "address": lambda: f"{number(rng.choice(('#', '##', '###', '####')))} {' '.join(name() for _ in range(rng.choice((1, 1, 2))))} {rng.choice(('Street', 'Avenue', 'Road', 'Lane', 'Drive', 'Boulevard', 'Court', 'Square'))}",
        "localphone": lambda: number(rng.choice(("(###) ###-####", "###-###-####", "###.###.####"))),
        "idnumber": lambda: number("###-##-####"),
    }
    lead = {
        "name": ["Mr. {}", "Mrs. {}", "Ms. {}", "Dr. {}", "Prof. {}", "Dear Mr. {}", "name: {}", "patient {}", "Herr {}", "Frau {}", "Madame {}", "Monsieur {}", "My name is {}"],
        "address": ["lives at {}", "address: {}", "{}", "resident at {}"],
        "localphone": ["phone: {}", "call {}", "tel {}", "fax {}", "{}", "mobile {}"],
        "idnumber": ["SSN {}", "social security number {}", "id: {}", "{}"],
    }
    noise = [
        lambda: number("################"), lambda: number("###.###.##.##"), lambda: "+1 " + number("(###) ###-####"), lambda: number("#.#"),
        lambda: f"Released under the {rng.choice(('Apache', 'MIT'))} License, Version {number('#.#')}.", lambda: f"page {number('##')}", lambda: f"order {number('######')}",
        lambda: f"{word()}.{number('##')}@mail{number('#')}.example.com", lambda: f'token = "{word()}{number("########")}"', lambda: name() + " " + name(), lambda: name().upper() + "!!",
        lambda: " ".join([name()] * rng.randint(3, 12)), lambda: " ".join([name() + "."] * rng.randint(3, 9)), lambda: " ".join(name() for _ in range(rng.randint(3, 9))), lambda: f"{word()} no. {name()} {word()}",
        lambda: f"in {number('####')}", lambda: word() + "###", lambda: name() + " | " + word(), lambda: number("##-##"), lambda: f"{number('##')} {name()}", lambda: "The call of " + word(), lambda: "no " + word(), lambda: "name of " + name(),
    ]
    table = []
    for i in range(size):
        parts, spans = [prose(0, 7)], []
        for _ in range(rng.choice((0, 1, 1, 2))):
            kind = rng.choice(LEARNED)
            before, after = rng.choice(lead[kind]).split("{}")
            value = fill[kind]()
            start = len(" ".join(p for p in parts if p)) + bool(any(parts)) + len(before)
            spans.append((start, start + len(value), kind))
            parts += [before + value + after, rng.choice((",", "", "")) and "," or "", prose(0, 5)]
        if i % 2 or not spans:
            parts += [rng.choice(noise)(), prose(0, 6)]
        table.append((" ".join(p for p in parts if p), spans))
    return table


@lru_cache(1)
def default_field() -> Field:
    return train(labelled_table())


def _plausible(kind: int, value: str) -> bool:
    """A last check of a decoded span: a name starts with a capital, an address with its number, the rest by digits."""
    digits = len(_DIGIT.findall(value))
    return (value[:1].isupper(), value[:1].isdigit(), 7 <= digits <= 11, digits == 9)[kind]


def field_spans(field: Field, texts: list[str]) -> list[list[Span]]:
    """Spans that the field finds in each text; all texts are decoded together."""
    joined = "\n".join(texts)
    words = Words(joined)
    labels = field.decode(words)
    hits = np.flatnonzero(labels)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    out: list[list[Span]] = [[] for _ in texts]
    last = None
    for i in hits.tolist():
        kind, inner = (labels[i] - 1) // 2, (labels[i] - 1) % 2
        if inner and last and last[0] == i - 1 and last[1] == kind and not words.first[i]:
            last[3] = int(words.end[i])
            last[0] = i
        else:
            last = [i, kind, int(words.start[i]), int(words.end[i])]
            doc = int(np.searchsorted(bounds, last[2], side="right"))
            out[doc].append(last)
    base = np.concatenate(([0], bounds)).tolist()
    return [[(s - base[d], len(BASE) + int(k), e - base[d]) for _, k, s, e in own if _plausible(int(k), joined[s:e])] for d, own in enumerate(out)]


#: Characters that are decoded together.
CHUNK = 400_000


def all_spans(field: Field, texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
    """Pattern spans, and all spans, of each text: learned spans that touch no pattern span are added."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
            size, to = size + len(texts[to]) + 1, to + 1
        chunk = texts[at:to]
        for text, learned in zip(chunk, field_spans(field, chunk), strict=True):
            base = pattern_spans(text)
            free = [s for s in learned if not any(b[0] < s[2] and s[0] < b[2] for b in base)] if base else learned
            yield base, sorted(base + free) if free else base
        at = to


def line(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """text with each group of overlapping spans replaced by the first one's kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def _mapped(df: DataFrame, column: str, fields: str, make, field: Field | None) -> DataFrame:
    """df and columns that make(text or None, base, all) gives; replaces columns of the same names."""
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(field or default_field())
    names = [f.split()[0] for f in fields.split(", ")]
    kept = [c for c in df.columns if c == column or c not in names]
    df = df.select(*[df[f"`{c}`"] for c in kept])
    at = kept.index(column)
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = all_spans(sent.value, [t or "" for t in texts])
            made = zip(*(make(t, *f) for t, f in zip(texts, found, strict=True)), strict=True)
            new = dict(zip(names, map(pa.array, made, types), strict=True)) if texts else {n: pa.array([], t) for n, t in zip(names, types, strict=True)}
            columns = [new.pop(c) if c in new else batch.column(i) for i, c in enumerate(kept)]
            yield pa.RecordBatch.from_arrays([*columns, *new.values()], names=[*kept, *new])

    new = [f for f in fields.split(", ") if f.split()[0] not in kept]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *new])
    return df.mapInArrow(run, ddl)


def report(df: DataFrame, column: str = "text", field: Field | None = None) -> DataFrame:
    """df and counts of pattern spans, the digest of their list and the list of all spans.

    Offsets are code points, ends exclusive. A null text counts as empty and has no spans.
    Repeated rows give repeated results, an empty table gives no rows, and columns of df
    that have a result's name are replaced. Spans that start together are in KINDS' order.
    """

    def make(text: str | None, base: list[Span], every: list[Span]) -> tuple:
        counts = [sum(s[1] == k for s in base) for k in range(len(BASE))]
        return (*counts, hashlib.sha256(line(base).encode()).hexdigest(), line(every))

    return _mapped(df, column, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make, field)


def mask(df: DataFrame, column: str = "text", length: str | None = "n_chars", field: Field | None = None) -> DataFrame:
    """df with personal data in a text column replaced by its kind, as in <EMAIL>.

    A length column of df, if named, is set to the new number of characters where a text
    changed. Null texts stay null, and texts without findings stay as they are; repeated
    rows stay, and an empty table stays empty.
    """
    extra = length if length in df.columns else None

    if extra is None:
        return _mapped(df, column, f"{column} string", lambda t, _, every: (masked(t, every) if every else t,), field)
    order, kinds = df.columns, dict(df.dtypes)

    def make(text: str | None, _: list[Span], every: list[Span]) -> tuple:
        new = masked(text, every) if every else text
        return new, (len(new) if every else None)

    marked = _mapped(df, column, f"{column} string, _callweave_length long", make, field)
    n = marked["_callweave_length"].cast(kinds[extra])
    from pyspark.sql import functions as F

    return marked.withColumn(extra, F.coalesce(n, marked[extra])).select(*[f"`{c}`" for c in order])
