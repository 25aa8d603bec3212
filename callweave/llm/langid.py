"""Language identification: known words first, then ever shorter character n-grams.

A word that was learned scores by its log frequency in each language; any other word by
the longest of its character n-grams that were learned. A word's scores are turned into
log shares over the languages, a text adds them up over its words and takes the best.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, let_go, materialise

#: The classifier is fitted on about so many labelled rows, drawn by hash from all of them;
#: every word and n-gram of these that occurs often enough is kept.
SAMPLE_ROWS = 6000
LONGEST = 5
#: A word or n-gram counts as known from so many occurrences.
LEAST = 2
#: Words without an entry that a worker remembers before it starts anew.
REMEMBERED = 300_000
UNKNOWN = "und"

_LETTERS = regex.compile(r"\p{L}+")
_FLOOR = -7.0


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of a word between its two edges."""
    edged = f"<{word}>"
    return [edged[i : i + n] for i in range(len(edged) - n + 1)] if n > 1 else list(word)


@dataclass
class Model:
    """Log shares of the languages, a row for each known word and each known n-gram."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_rows: np.ndarray
    gram_rows: np.ndarray


class Scorer:
    """Log shares of words by language, as rows of one matrix."""

    def __init__(self, model: Model):
        self.model = model
        self.known = model.words
        width = len(model.languages)
        self.rows = np.zeros((len(self.known) + REMEMBERED, max(1, width)), np.float32)
        if self.known:
            self.rows[: len(self.known)] = model.word_rows
        self.seen: dict[str, int] = {}

    def _known_grams(self, word: str) -> list[int]:
        """Rows of the known n-grams of the greatest length that has any."""
        get = self.model.grams.get
        for n in range(LONGEST, 0, -1):
            found = [v for g in grams_of(word, n) if (v := get(g)) is not None]
            if found:
                return found
        return []

    def backoff(self, words: list[str]) -> np.ndarray:
        """A row for each word: the mean over its known n-grams of the greatest length that has any."""
        found = [self._known_grams(w) for w in words]
        sizes = np.array([len(f) for f in found])
        out = np.full((len(words), len(self.model.languages)), -math.log(len(self.model.languages)), np.float32)
        some = sizes > 0
        if some.any():
            sums = np.add.reduceat(self.model.gram_rows[list(chain.from_iterable(found))], (np.cumsum(sizes) - sizes)[some], axis=0)
            out[some] = sums / sizes[some, None]
        return out

    def _remember(self, words: list[str]) -> None:
        at = len(self.known) + len(self.seen)
        self.rows[at : at + len(words)] = self.backoff(words)
        for i, w in enumerate(words):
            self.seen[w] = at + i

    def predict(self, text: str | None) -> tuple[str, float]:
        """The best language and the geometric mean of its shares in the words."""
        counts = Counter(words_of(text))
        if not counts or not self.model.languages:
            return UNKNOWN, 0.0
        if len(self.seen) + len(counts) > REMEMBERED:
            self.seen.clear()
        known, seen = self.known, self.seen
        total, n, items, at = np.zeros(len(self.model.languages)), 0, list(counts.items()), 0
        while at < len(items):  # a very long text in parts, so that no part outgrows the memory
            part = items[at : at + REMEMBERED // 2]
            if len(seen) + len(part) > REMEMBERED:
                seen.clear()
            fresh = [w for w, _ in part if w not in known and w not in seen]
            if fresh:
                self._remember(fresh)
            index = [known[w] if w in known else seen[w] for w, _ in part]
            times = np.array([c for _, c in part], np.float64)
            total += times @ self.rows[index].astype(np.float64)
            n, at = n + int(times.sum()), at + len(part)
        best = int(np.argmax(total))
        return self.model.languages[best], float(min(1.0, math.exp(total[best] / n)))


def remainder(id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(4))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from rows with a text and a language; rows that lack either are ignored.

    Everything is counted by Spark over the sample; what reaches the driver is one row for
    each word and n-gram of it that occurs LEAST times, so it is bounded by sample_rows.
    Repeated rows count as often as they are there. Without rows the model has no language.
    """
    bounded_batches(labelled.sparkSession)
    labelled = labelled.where(F.col(lang).isNotNull())
    n = labelled.count()
    share = int(1_000_000 * min(1.0, sample_rows / max(1, n)))
    drawn = labelled.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in labelled.columns]), F.lit(1_000_000)) < share)
    counts = drawn.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("text is not null").mapInArrow(_counts, "n int, token string, lang string, times long")
    counts = materialise(counts.groupBy("n", "token", "lang").agg(F.sum("times").alias("times")), "language-counts")
    totals = {(r.k, r.lang): r.times for r in counts.groupBy(F.least("n", F.lit(1)).alias("k"), "lang").agg(F.sum("times").alias("times")).collect()}
    languages = sorted({lang for _, lang in totals})

    def table(k: int) -> tuple[dict[str, int], np.ndarray]:
        own = [F.sum(F.when(F.col("lang") == x, F.col("times")).otherwise(0)).alias(f"l{i}") for i, x in enumerate(languages)]
        rows = counts.where("n = 0" if not k else "n > 0").groupBy("token").agg(F.sum("times").alias("all"), *own).where(F.col("all") >= LEAST).drop("all").toArrow()
        freq = np.stack([(rows.column(i + 1).to_numpy() + 0.05) / (totals.get((k, x), 0) + 1) for i, x in enumerate(languages)], 1) if languages else np.zeros((0, 0))
        shares = np.maximum(_FLOOR, np.log(freq / freq.sum(1, keepdims=True)))
        return {t: i for i, t in enumerate(rows.column(0).to_pylist())}, shares.astype(np.float32)

    (words, word_rows), (grams, gram_rows) = table(0), table(1)
    discard(counts)
    return Model(languages, words, grams, word_rows, gram_rows)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Times of each word (n = 0) and n-gram of each language in a partition."""
    let_go()
    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text))
    for lang, own in words.items():
        grams: Counter = Counter()
        for word, times in own.items():
            for n in range(1, LONGEST + 1):
                for g in grams_of(word, n):
                    grams[n, g] += times
        for rows in ([(0, w, t) for w, t in own.items()], [(n, g, t) for (n, g), t in grams.items()]):
            for at in range(0, len(rows), 50_000):
                n, token, times = zip(*rows[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(token), pa.array([lang] * len(n)), pa.array(times, pa.int64())], names=["n", "token", "lang", "times"])


def predict(df: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """df and lang_pred string, score double (0 to 1) of a text column.

    Nothing but the text counts. A null text or one without letters gives und and 0; ties
    go to the first language by name. Columns of df of these names are replaced.
    """
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    df = df.select(*[df[f"`{c}`"] for c in kept])
    at = kept.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        scorer = Scorer(sent.value)
        for batch in batches:
            made = [scorer.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=[*kept, "lang_pred", "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{ddl}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Learns from the documents whose remainder is 0, 1 or 3. A document without an id is
    neither learned from nor held out. A null text, or one without letters, is und with
    score 0; repeated rows stay, and an empty table gives no rows.
    """
    rest = remainder()
    model = fit(docs.where(rest != 2).select("doc_id", "text", "lang"))
    found = predict(docs.select("doc_id", "text"), model).drop("text")
    return found.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told; the others are rejected.

    Null texts and texts without letters go; ties of languages are no reason to go.
    Repeated rows stay, an empty table stays empty, other columns are kept as they are.
    """
    model = fit(docs.where(remainder() != 2).select("doc_id", "text", "lang"))
    names = docs.columns
    free = {c: f"_c{i}" for i, c in enumerate(names)}
    wide = docs.select(*[F.col(f"`{c}`").alias(free[c]) for c in names])
    kept = predict(wide, model, free["text"]).where(F.col("lang_pred") != UNKNOWN)
    return kept.select(*[F.col(free[c]).alias(c) for c in names])
