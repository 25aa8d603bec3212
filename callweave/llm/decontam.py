"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

A text becomes its words in lower case, with numbers (figures and number words), names
(capitalised words, wherever they stand: a word's own form decides, so that a passage reads
the same in each surrounding) and units replaced by typed placeholders. An item is also read
without names, for documents that are in capitals or in small letters throughout. Windows of five
such words are hash-joined with those of the benchmark items. Hits on one diagonal
(position in the document less position in the item) must have consistent slots: one value
of the item answers to one value of the document throughout, and the other way round; hits
whose slots are all unchanged count in any case. Diagonals that lie close together, as
after an insertion, are then merged; where their slots contradict each other, the value
with more hits stands and hits with another go. A document leaks an item if the remaining
windows cover at least four fifths (COVER) of the item's words.

The windows of all documents meet only the hashes of seeds: a leak has ceil(COVER n / 5)
windows of an item of n words at least, so as many less one, the most common ones among the
items, need not be looked for. Only documents that hold a seed get slots and positions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, small_enough, without

WINDOW = 5
COVER = 0.8
#: Units that are a slot wherever they stand, by rule, and short ones that are only after a number.
_MEASURES = "meter metre gram liter litre watt volt joule byte hertz ton tonne".split()
UNITS = sorted(
    {p + m + s for p in ("", "kilo", "centi", "milli", "mega", "giga", "micro", "deci") for m in _MEASURES for s in ("", "s")}
    | {u + s for u in "inch mile yard acre ounce pound gallon pint quart second minute hour day week month year cent dollar euro degree dozen hectare".split() for s in ("", "s")}
    | set("feet foot inches percent celsius fahrenheit kmh mph usd eur gbp lbs kg km cm mm mg ml".split())
)
SHORT_UNITS = "m in ft yd mi g t lb oz l s sec min h c f k w kw v a hz".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice".split()

_TOKEN = r"[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*"
_NUMBER, _NAME, _UNIT = "#n", "#m", "#u"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column, make: Callable[[Column, Column], Column], names: bool = True) -> Column:
    """An array of make(class, lower-case word) of the words of a text; the class of a word
    that is no slot is the word. Without names, capitals tell nothing."""
    figure = lambda x: (x >= "0") & (x < ":")

    def typed(raw: Column, low: Column) -> Column:
        def one(word: Column, i: Column) -> Column:
            x = F.get(raw, i)
            after = lambda: (i > 0) & figure(F.get(raw, i - 1))
            name = F.lit(names) & (x != word) & (F.length(x) > 1) & (F.substr(x, F.lit(2)) == F.substr(word, F.lit(2)))
            kind = F.when(figure(word) | word.isin(NUMBERS), F.lit(_NUMBER)).when(word.isin(UNITS) | (word.isin(SHORT_UNITS) & after()), F.lit(_UNIT)).when(name, F.lit(_NAME))
            return make(kind.otherwise(word), word)

        return F.transform(low, one)

    raw = F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1))
    return _let(raw, lambda raw: _let(F.transform(raw, F.lower), lambda low: typed(raw, low)))


def _slots(text: Column, names: bool = True) -> Column:
    """Array of (c: word or placeholder, s: the value of a slot, else '')."""
    return _words(text, lambda kind, word: F.struct(kind.alias("c"), F.when(kind == word, "").otherwise(word).alias("s")), names)


def _hashed(words: Column, size: int) -> Column:
    """Hashes of all windows of `size` word hashes."""
    places = lambda w: F.sequence(F.lit(0), F.size(w) - size)
    return _let(words, lambda w: F.when(F.size(w) >= size, F.transform(places(w), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))))


def _windows(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, at int, h long and v (slot values) of each window of `size` words of _words."""
    hashes = _hashed(F.transform("_words", lambda w: F.xxhash64(w["c"])), size)
    cut = df.select(*keys, "_words", F.posexplode(hashes).alias("at", "h"))
    return cut.select(*keys, "at", "h", F.transform(F.slice("_words", F.col("at") + 1, F.lit(size)), lambda w: w["s"]).alias("v"))


def _seeds(grid: DataFrame) -> DataFrame:
    """Hashes (h) of the windows (item_id, n, h) without which an item cannot be leaked."""
    once = grid.select("item_id", "n", "h").distinct()
    common = once.join(once.groupBy("h").agg(F.count("*").alias("items")), "h")
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("items"), "h"))
    spare = F.ceil(F.col("n") * COVER / WINDOW) - 1 - (F.col("all") - F.col("kinds"))  # equal windows of an item are one row
    counted = common.join(grid.groupBy("item_id").agg(F.count("*").alias("all"), F.countDistinct("h").alias("kinds")), "item_id")
    return counted.withColumn("rank", rank).where(F.col("rank") > F.greatest(spare, F.lit(0))).select("h").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, coverage, n_slots, n_changed of each leaked item.

    docs (doc_id, text) and benchmark (item_id, text); other columns are ignored. Null
    texts and texts without words leak nothing and are leaked by nothing; an empty table on
    either side gives no rows. Items of fewer than five words are compared in windows of
    their own length. Rows that repeat an id with another text are told apart by text_hash;
    repeated rows count as one. Of two document values that answer to one value of the item
    equally often the first by name stands. n_slots and n_changed count the distinct slot
    values of the item that were met, and those that the document has replaced.
    """
    asked = benchmark.where("text is not null")
    items = reduce(DataFrame.union, [asked.select("item_id", _slots(F.col("text"), names).alias("_words")) for names in (True, False)]).where(F.size("_words") > 0)
    items = materialise(items.select("item_id", "_words", F.size("_words").alias("n")), "items")
    sizes = sorted(r.k for r in items.select(F.least("n", F.lit(WINDOW)).alias("k")).distinct().collect())
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    parts = []
    for k in sizes or [WINDOW]:
        own = items.where(F.least("n", F.lit(WINDOW)) == k)
        grid = materialise(_windows(own, ["item_id", "n"], k).select("item_id", "n", F.col("at").alias("q"), "h", F.col("v").alias("iv")).distinct(), "item-windows")
        seeds = materialise(_seeds(grid), "seeds")
        hashes = _hashed(_words(F.col("text"), lambda kind, _: F.xxhash64(kind)), k)
        seen = rows.select("doc_id", "text_hash", F.explode(hashes).alias("h")).join(F.broadcast(seeds) if small_enough(seeds) else seeds, "h", "left_semi")
        seen = materialise(seen.select("doc_id", "text_hash").distinct(), "seen")
        near = rows.alias("r").join((F.broadcast(seen) if small_enough(seen) else seen).alias("s"), F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.text_hash") == F.col("s.text_hash")), "left_semi")
        hits = _windows(near.select("doc_id", "text_hash", _slots(F.col("text")).alias("_words")), ["doc_id", "text_hash"], k).join(F.broadcast(grid) if small_enough(grid) else grid, "h")
        parts.append(_covered(materialise(hits, "hits"), k))
    found = reduce(DataFrame.union, parts)
    return found.where(F.col("coverage") >= COVER).groupBy("doc_id", "text_hash", "item_id").agg(F.max("coverage").alias("coverage"), F.max("n_slots").alias("n_slots"), F.max("n_changed").alias("n_changed"))


def _covered(hits: DataFrame, k: int) -> DataFrame:
    """Coverage of items by the windows of close diagonals with consistent slots."""
    keys = ["doc_id", "text_hash", "item_id", "n"]
    pairs = F.array_distinct(F.filter(F.transform(F.arrays_zip("iv", "v"), lambda z: F.struct(z["iv"].alias("i"), z["v"].alias("d"))), lambda z: z["i"] != ""))
    at = hits.select(*keys, (F.col("at") - F.col("q")).alias("diagonal"), "q", pairs.alias("pairs")).distinct()
    distinct = lambda side: F.size(F.array_distinct(F.transform("all", lambda p: p[side])))
    diagonals = at.groupBy(*keys, "diagonal").agg(F.collect_set(F.struct("q", "pairs")).alias("hits"))
    diagonals = diagonals.withColumn("all", F.array_distinct(F.flatten(F.col("hits.pairs"))))
    consistent = (distinct("i") == F.size("all")) & (distinct("d") == F.size("all"))
    unchanged = F.filter("hits", lambda h: F.forall(h["pairs"], lambda p: p["i"] == p["d"]))
    good = diagonals.select(*keys, "diagonal", F.explode(F.when(consistent, F.col("hits")).otherwise(unchanged)).alias("hit"))
    near = F.greatest(F.floor(F.col("n") / 4), F.lit(4))
    place = F.floor(F.col("diagonal") / near)
    placed = good.select(*keys, F.explode(F.array(place, place + 1)).alias("place"), "hit.q", "hit.pairs")

    slots = placed.select(*keys, "place", F.explode("pairs").alias("p")).groupBy(*keys, "place", "p.i", "p.d").agg(F.count("*").alias("times"))
    first = lambda one, other: F.row_number().over(W.partitionBy(*keys, "place", one).orderBy(F.desc("times"), other))
    wrong = slots.withColumn("a", first("i", "d")).withColumn("b", first("d", "i")).where("a > 1 or b > 1")
    wrong = wrong.groupBy(*keys, "place").agg(F.collect_set(F.struct("i", "d")).alias("wrong")).select(*[F.col(c).alias(f"_{c}") for c in (*keys, "place")], "wrong")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, "place")])
    stays = placed.join(wrong, same, "left").where("wrong is null or not arrays_overlap(pairs, wrong)")
    merged = stays.groupBy(*keys, "place").agg(F.array_sort(F.collect_set("q")).alias("qs"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    words = F.aggregate(
        "qs",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda s, q: F.struct((q + k).alias("end"), (s["sum"] + q + k - F.greatest(s["end"], q)).alias("sum")),
        lambda s: s["sum"],
    )
    return merged.select(
        *keys,
        (words / F.col("n")).alias("coverage"),
        F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))).cast("long").alias("n_slots"),
        F.size(F.array_distinct(F.transform(F.filter("pairs", lambda p: p["i"] != p["d"]), lambda p: p["i"]))).cast("long").alias("n_changed"),
    ).drop("n")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leaked item and document; rows that repeat an id are merged."""
    return leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("n_slots").alias("n_slots"), F.max("n_changed").alias("n_changed"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no benchmark item; null texts stay."""
    found = materialise(leaks(docs, benchmark).select("doc_id", "text_hash").distinct(), "leaks")
    return without(docs, found, "doc_id", "text")


def oracle_sql() -> str:
    """The same leaks in SQL: every window of every document, without seeds."""
    listed = lambda words: ", ".join(f"'{w}'" for w in words)

    def words(table: str, key: str) -> str:
        return f"""
  SELECT {key}, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS x, len(t) AS n
  FROM (SELECT {key}, regexp_extract_all(text, '{_TOKEN}') AS t FROM {table} WHERE text IS NOT NULL)"""

    def typed(source: str, key: str, names: str = "true") -> str:
        return f"""
  SELECT {key}, pos, n, CASE WHEN num THEN '{_NUMBER}' WHEN unit THEN '{_UNIT}' WHEN name THEN '{_NAME}' ELSE l END AS c, CASE WHEN num OR unit OR name THEN l ELSE '' END AS s
  FROM (SELECT *, lower(x) AS l, (x >= '0' AND x < ':') OR lower(x) IN ({listed(NUMBERS)}) AS num,
          lower(x) IN ({listed(UNITS)}) OR (lower(x) IN ({listed(SHORT_UNITS)}) AND coalesce(lag(x >= '0' AND x < ':') OVER (PARTITION BY {key} ORDER BY pos), false)) AS unit,
          {names} AND x <> lower(x) AND length(x) > 1 AND substr(x, 2) = substr(lower(x), 2) AS name
        FROM {source})"""

    def windows(source: str, key: str) -> str:
        cs = ", ".join(f"lead(c, {k}) OVER w AS c{k}" for k in range(WINDOW))
        ss = ", ".join(f"lead(s, {k}) OVER w" for k in range(WINDOW))
        return f"""
  SELECT * FROM (SELECT {key}, pos, n, {cs}, [{ss}] AS v FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY pos)) WHERE c{WINDOW - 1} IS NOT NULL"""

    on = " AND ".join(f"d.c{k} = i.c{k}" for k in range(WINDOW))
    return f"""
WITH dw AS ({words("documents", "doc_id")}), iw AS ({words("benchmark", "item_id")}),
dt AS ({typed("dw", "doc_id")}), it AS ({typed("iw", "item_id")}), iu AS ({typed("iw", "item_id", "false")}),
dg AS ({windows("dt", "doc_id")}), ig AS ({windows("it", "item_id")} UNION {windows("iu", "item_id")}),
hits AS (SELECT doc_id, item_id, i.n, d.pos - i.pos AS diagonal, i.pos AS q, i.v AS iv, d.v AS dv, i.v = d.v AS unchanged FROM dg d JOIN ig i ON {on}),
pairs AS (SELECT doc_id, item_id, diagonal, unnest(iv) AS i, unnest(dv) AS d FROM hits),
slots AS (SELECT doc_id, item_id, diagonal, count(DISTINCT i) AS ni, count(DISTINCT d) AS nd, count(DISTINCT (i, d)) AS np FROM pairs WHERE i <> '' GROUP BY ALL),
good AS (SELECT h.* FROM hits h LEFT JOIN slots s USING (doc_id, item_id, diagonal) WHERE s.ni IS NULL OR (s.ni = s.np AND s.nd = s.np) OR unchanged),
placed AS (SELECT *, unnest([p, p + 1]) AS place FROM (SELECT *, floor(diagonal / greatest(floor(n / 4), 4)) AS p FROM good)),
met AS (SELECT DISTINCT doc_id, item_id, place, diagonal, q, i, d FROM (SELECT doc_id, item_id, place, diagonal, q, unnest(iv) AS i, unnest(dv) AS d FROM placed) WHERE i <> ''),
times AS (SELECT doc_id, item_id, place, i, d, count(*) AS times FROM met GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, place, i ORDER BY times DESC, d) AS a, row_number() OVER (PARTITION BY doc_id, item_id, place, d ORDER BY times DESC, i) AS b FROM times),
wrong AS (SELECT DISTINCT doc_id, item_id, place, diagonal, q FROM met JOIN ranked USING (doc_id, item_id, place, i, d) WHERE a > 1 OR b > 1),
stays AS (SELECT * FROM placed ANTI JOIN wrong USING (doc_id, item_id, place, diagonal, q)),
covered AS (SELECT DISTINCT doc_id, item_id, n, place, q + k AS word FROM stays, (SELECT unnest(range({WINDOW})) AS k)),
cover AS (SELECT doc_id, item_id, place, count(*) / any_value(n) AS coverage FROM covered GROUP BY doc_id, item_id, place),
kept AS (SELECT doc_id, item_id, place, unnest(iv) AS i, unnest(dv) AS d FROM stays),
slotted AS (SELECT doc_id, item_id, place, count(DISTINCT i) AS n_slots, count(DISTINCT i) FILTER (WHERE i <> d) AS n_changed FROM kept WHERE i <> '' GROUP BY ALL)
SELECT doc_id, item_id, max(coverage) AS coverage, max(coalesce(n_slots, 0)) AS n_slots, max(coalesce(n_changed, 0)) AS n_changed
FROM cover LEFT JOIN slotted USING (doc_id, item_id, place) WHERE coverage >= {COVER} GROUP BY doc_id, item_id
"""
