"""Secret scans by multipart credential linking, in DataFrame functions alone.

Strong patterns are reported as they are. Weak candidates (an account name, a short
secret, a bare 40-character key, an endpoint) are common in harmless text; they are
reported only where the parts of a credential come together. The parts of a row are
sorted by position and joined by interval: a part looks at the neighbours whose start
lies within SCOPE code points of its own. Matches of one kind do not overlap and have a
least length, so those neighbours are at most REACH places away in the sorted parts:
the join reads a bounded slice for each part, needs no shuffle and misses no pair.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points between the starts of parts that belong together.
SCOPE = 200


def _either(word: str) -> str:
    """A pattern for word in either case, the same in each regex dialect."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _assigned(words: str, value: str) -> str:
    return rf"""({words})["']?\x20*[:=]\x20*["']?({value})"""


_VALUE = "[A-Za-z0-9+/_.=-]+"
_WORDS = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
_NAMES = "|".join(map(_either, ("username", "user_id", "user", "login", "client_id", "account", "key_id")))
_HINTS = "|".join(map(_either, ("secret_key", "private_key", "pwd", "credential", "passphrase")))

#: kind, part it plays, pattern, least length of a match, least and most characters
#: of the group that is measured (0: the match), and literals of which each match holds
#: one: a text without them need not be searched. Kinds in the order of reports.
STRONG = [
    ("assign", "secret", _assigned(_WORDS, _VALUE), 18, 2, 12, None, ":="),
    ("access", "id", "AKIA[A-Z0-9]+", 18, 0, 18, None, ["AKIA"]),
    ("hex", "secret", "[0-9a-f]{16,}", 16, 0, 16, None, None),
]
WEAK = [
    ("weak_id", "id", _assigned(_NAMES, "[A-Za-z0-9._@-]{3,}"), 8, 0, 8, None, ":="),
    ("weak_secret", "secret", _assigned(f"{_WORDS}|{_HINTS}", _VALUE), 10, 2, 6, 11, ":="),
    ("weak_hint", "secret", _assigned(_HINTS, _VALUE), 10, 2, 12, None, ":="),
    ("weak_key", "secret", "[A-Za-z0-9+/=]{40,}", 40, 0, 40, 40, None),
    ("endpoint", "endpoint", r"(https?|jdbc:[a-z0-9]+|postgres|mysql|redis|amqp|mongodb)://[A-Za-z0-9._~:/?#@!&+=%-]{3,}", 10, 0, 10, None, ["://"]),
]
#: Places in the sorted parts within which all starts at most SCOPE away lie.
REACH = sum(SCOPE // k[3] + 1 for k in STRONG + WEAK)

_SPAN = "struct<start:int,rank:int,end:int,kind:string,part:string,weak:boolean>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running results of op (sum or greatest, from 0) over an array of numbers.

    An array grows by copies, so the array is cut into blocks of its square root: each block
    is carried on from the result of all before it, and no long array is copied often.
    """

    def grown(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda s, v: F.struct(op(s["at"], v).alias("at"), F.concat(s["out"], F.array(op(s["at"], v))).alias("out")), lambda s: s["out"])

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), op))
        return _let(grown(totals, F.lit(0)), lambda upto: F.flatten(F.transform(parts, lambda p, k: grown(p, F.when(k > 0, F.get(upto, k - 1)).otherwise(0)))))

    def cut(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.when(F.size(v) > 0, _let(F.transform(F.sequence(F.lit(0), F.size(v) - 1, size), lambda i: F.slice(v, i + 1, size)), joined)).otherwise(F.array().cast("array<int>"))

    return _let(values, cut)


def _spans(text: Column, rank: int, kind: tuple, weak: bool) -> Column:
    """All matches of a kind as an array of spans, leftmost first, failing ones dropped.

    split() gives the text between the matches, so ends are running sums of lengths.
    """
    name, part, pattern, _, group, least, most, literals = kind
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("n"), (F.length(F.regexp_extract(match, pattern, group)) if group else F.length(match)).alias("size")),
    )

    def placed(p: Column) -> Column:
        ends = _running(F.transform(p, lambda x: x["gap"] + x["n"]), lambda x, y: x + y)
        spans = F.zip_with(p, ends, lambda x, end: F.struct((end - x["n"]).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(name).alias("kind"), F.lit(part).alias("part"), F.lit(weak).alias("weak"), x["size"].alias("size")))
        fits = lambda x: (x["size"] >= least) & (x["size"] <= most) if most else x["size"] >= least
        return F.transform(F.filter(spans, fits), lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "kind", "part", "weak")]))

    there = text.rlike(pattern)
    if literals:
        there = reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in literals]) & there
    return F.when(there, _let(F.filter(pieces, lambda p: p["n"].isNotNull()), placed)).otherwise(_none())


def _none() -> Column:
    return F.from_json(F.lit("[]"), f"array<{_SPAN}>")


def _apart(strong: Column, weak: Column) -> Column:
    """The weak spans that overlap no strong one.

    Starts of strong spans and ends of weak ones are sorted together. The greatest end of
    the strong spans so far is, at a weak span's end, that of all that start before it.
    """

    def among(events: Column) -> Column:
        ends = _running(F.transform(events, lambda e: e["upto"]), lambda x, y: F.greatest(x, y))
        return F.transform(F.filter(F.zip_with(events, ends, lambda e, end: F.struct(e.alias("e"), end.alias("end"))), lambda z: z["e"]["span"].isNotNull() & (z["end"] <= z["e"]["span"]["start"])), lambda z: z["e"]["span"])

    starts = F.transform(strong, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("turn"), s["end"].alias("upto"), F.lit(None).cast(_SPAN).alias("span")))
    ends = F.transform(weak, lambda w: F.struct(w["end"].alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("upto"), w.alias("span")))
    return F.when((F.size(strong) > 0) & (F.size(weak) > 0), _let(F.array_sort(F.concat(starts, ends)), among)).otherwise(weak)


def _linked(spans: Column) -> Column:
    """The strong spans, and the weak ones whose complementary parts are in scope."""

    def stays(all_: Column) -> Column:
        def near(span: Column, i: Column, part: str) -> Column:
            around = F.slice(all_, F.greatest(i + 1 - REACH, F.lit(1)), F.lit(2 * REACH + 1))
            return F.exists(around, lambda o: (o["part"] == part) & (F.abs(o["start"] - span["start"]) <= SCOPE))

        def keep(span: Column, i: Column) -> Column:
            other = F.when(span["part"] == "id", near(span, i, "secret")).when(span["part"] == "secret", near(span, i, "id"))
            return ~span["weak"] | other.otherwise(near(span, i, "secret") & near(span, i, "id"))

        return F.filter(all_, keep)

    return _let(spans, lambda all_: F.when(F.exists(all_, lambda s: s["weak"]), stays(all_)).otherwise(all_))


def _is(value: str) -> Callable[[Column], Column]:
    return lambda x: x == value


def _named(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], span["start"], span["end"])


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, _named), ",")


def _credentials(spans: Column) -> Column:
    """secret+id or secret+id+endpoint of each secret that has an id in scope: the nearest
    of each, of two as near the one that comes first."""

    def nearest(all_: Column, s: Column, i: Column, part: str) -> Column:
        around = F.filter(F.slice(all_, F.greatest(i + 1 - REACH, F.lit(1)), F.lit(2 * REACH + 1)), lambda o: (o["part"] == part) & (F.abs(o["start"] - s["start"]) <= SCOPE))
        return _named(F.array_min(F.transform(around, lambda o: F.struct(F.abs(o["start"] - s["start"]).alias("far"), *[o[c].alias(c) for c in ("start", "rank", "end", "kind")]))))

    def there(all_: Column, s: Column, i: Column, part: str) -> Column:
        return F.exists(F.slice(all_, F.greatest(i + 1 - REACH, F.lit(1)), F.lit(2 * REACH + 1)), lambda o: (o["part"] == part) & (F.abs(o["start"] - s["start"]) <= SCOPE))

    def one(all_: Column) -> Callable[[Column, Column], Column]:
        def line(s: Column, i: Column) -> Column:
            endpoint = F.when(there(all_, s, i, "endpoint"), F.concat(F.lit("+"), nearest(all_, s, i, "endpoint"))).otherwise("")
            return F.when((s["part"] == "secret") & there(all_, s, i, "id"), F.concat(_named(s), F.lit("+"), nearest(all_, s, i, "id"), endpoint)).otherwise("")

        return line

    found = _let(spans, lambda all_: F.filter(F.transform(all_, one(all_)), lambda x: x != ""))
    return F.when(F.exists(spans, lambda s: s["part"] == "id") & F.exists(spans, lambda s: s["part"] == "secret"), F.array_join(found, ",")).otherwise("")


def scan(df: DataFrame, column: str = "text", into: str = "found") -> DataFrame:
    """df and an array of spans of credentials in a text column.

    A span has start and end (code points, end exclusive), kind, the part it plays and
    whether it is weak. A null text counts as empty; a text without findings gives an
    empty array. A weak span that overlaps a strong one is dropped. Repeated rows give
    repeated results. A column of df that is called like `into` is replaced.
    """
    text = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    strong = F.concat(*[_spans(text, i, k, False) for i, k in enumerate(STRONG)])
    weak = F.concat(*[_spans(text, len(STRONG) + i, k, True) for i, k in enumerate(WEAK)])
    both = _let(F.array_sort(strong), lambda s: F.concat(s, _let(weak, lambda w: _apart(s, w))))
    return df.withColumn(into, _linked(F.array_sort(both)))


def report(df: DataFrame, column: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of strong findings, the digest of their list, the list of all findings, and
    which of them make a credential together.

    A null text counts as empty and has no findings; repeated rows give repeated results,
    an empty table gives no rows. Spans that start together are in the order of kinds.
    """
    found = scan(df.select(*keys, F.col(f"`{column}`").alias("_text")), "_text", "_found").drop("_text")
    base = F.filter("_found", lambda s: ~s["weak"])
    counts = [F.size(F.filter(F.transform("_found", lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select(*keys, *counts, F.sha2(_line(base).cast("binary"), 256).alias("base_sha256"), _line(F.col("_found")).alias("spans"), _credentials(F.col("_found")).alias("credentials"))


def oracle_sql() -> str:
    """The same spans in SQL: splits for positions, and every pair of parts of a text."""
    found = []
    for rank, (name, part, pattern, _, group, least, most, _) in enumerate(STRONG + WEAK):
        p = pattern.replace("'", "''")
        size = f"length(regexp_extract(m, '{p}', {group}))" if group else "length(m)"
        fits = f"{size} >= {least}" + (f" AND {size} <= {most}" if most else "")
        found.append(f"""SELECT doc_id, s AS start, {rank} AS rank, s + length(m) AS stop, '{name}' AS kind, '{part}' AS part FROM (
  SELECT doc_id, m, sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
    SELECT doc_id, unnest(g[:len(m)]) AS g, unnest(m) AS m, generate_subscripts(m, 1) AS i FROM (
      SELECT doc_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m FROM d WHERE regexp_matches(t, '{p}')))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {fits}""")
    n = len(STRONG)

    def near(part: str) -> str:
        return f"EXISTS (FROM f o WHERE o.doc_id = f.doc_id AND o.part = '{part}' AND abs(o.start - f.start) <= {SCOPE})"

    def nearest(part: str) -> str:
        return f"SELECT s.doc_id, s.span, arg_min(o.span, (abs(o.start - s.start), o.start, o.rank)) AS near FROM k s JOIN k o ON o.doc_id = s.doc_id AND s.part = 'secret' AND o.part = '{part}' AND abs(o.start - s.start) <= {SCOPE} GROUP BY s.doc_id, s.span"

    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS ({" UNION ALL ".join(found)}),
f AS (SELECT * FROM c WHERE rank < {n} OR NOT EXISTS (FROM c s WHERE s.doc_id = c.doc_id AND s.rank < {n} AND s.start < c.stop AND c.start < s.stop)),
k AS (SELECT *, kind || ':' || start::BIGINT || ':' || stop::BIGINT AS span FROM f WHERE rank < {n} OR CASE part WHEN 'id' THEN {near("secret")} WHEN 'secret' THEN {near("id")} ELSE {near("secret")} AND {near("id")} END),
i AS ({nearest("id")}), e AS ({nearest("endpoint")}),
p AS (SELECT k.doc_id, string_agg(k.span || '+' || i.near || coalesce('+' || e.near, ''), ',' ORDER BY k.start, k.rank) AS credentials FROM k JOIN i ON i.doc_id = k.doc_id AND i.span = k.span LEFT JOIN e ON e.doc_id = k.doc_id AND e.span = k.span GROUP BY k.doc_id)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < {n}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans, coalesce(any_value(credentials), '') AS credentials
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id"""
