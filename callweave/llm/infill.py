"""Fill-in-the-middle examples: documents cut into prefix, middle and suffix, put in a new order.

The cuts lie between units (lines). A delimiter is injected after each unit by
regexp_replace, in a text in which the delimiter itself has been escaped; the number of
delimiters is the number of units, substring_index takes the units up to a rank or from
one on, and the parts are unescaped and put together with marks. All of it are column
functions on the row: no shuffle, no Python, and whole texts of any length.

Where the cuts lie and which order is taken follows from a digest of the seed and the
document's id, so that every run and every engine gives the same examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: the marks before prefix, suffix and middle, the seed, and of
#: a hundred documents those that are transformed, and of these those with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
UNIT = r"[^\n]*\n|[^\n]+"

#: The injected delimiter and the escape character; in texts they become two characters each.
_MARK, _ESCAPE = "\x1e", "\x1f"


def escape(text: Column) -> Column:
    """text without the delimiter, to be undone by unescape()."""
    out = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e"))
    return F.replace(out, F.lit(_MARK), F.lit(_ESCAPE + "m"))


def unescape(text: Column) -> Column:
    """What escape() was given; injected delimiters go."""
    out = F.replace(text, F.lit(_MARK), F.lit(""))
    out = F.replace(out, F.lit(_ESCAPE + "m"), F.lit(_MARK))
    return F.replace(out, F.lit(_ESCAPE + "e"), F.lit(_ESCAPE))


def _index(text: Column, count: Column) -> Column:
    """substring_index with a count that is a column."""
    return F.call_function("substring_index", text, F.lit(_MARK), count.cast("int"))


def _draw(digest: Column, i: int) -> Column:
    """The i-th group of eight hex digits, as a number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def assemble(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restore(output: Column, form: Column) -> Column:
    """The text that assemble() was given, from its output and form alone.

    Texts with a mark are never cut, and no mark overlaps itself, so the first place where
    a mark stands is the one that was put there.
    """
    second, third = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    body = F.call_function("substr", output, F.lit(len(PREFIX) + 1))
    before = F.call_function("substring_index", body, second, F.lit(1))
    rest = F.call_function("substr", body, F.length(before) + F.lit(len(SUFFIX) + 1))
    after = F.call_function("substring_index", rest, third, F.lit(1))
    middle = F.call_function("substr", rest, F.length(after) + F.lit(len(MIDDLE) + 1))
    joined = F.when(form == "psm", F.concat(before, middle, after)).otherwise(F.concat(after, middle, before))
    return F.when(form.isin("psm", "spm"), joined).otherwise(output)


def transform(df: DataFrame, id_column: str = "doc_id", column: str = "text", unit: str = UNIT, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output of every text.

    unit is a pattern whose matches, from left to right, make up every text. Null texts
    count as empty; empty texts, texts with a mark and those that the rate leaves out are
    plain, which is the text itself, with null in prefix_chars and middle_chars. A null id
    draws as one without digits. Repeated rows give repeated results, an empty table none;
    other columns of df are ignored.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    out = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(column), F.lit("")).alias("text"), digest.alias("digest"))
    out = out.select("id", "text", F.regexp_replace(escape(F.col("text")), f"(?:{unit})", f"$0{_MARK}").alias("marked"), *[_draw(F.col("digest"), i).alias(f"h{i + 1}") for i in range(4)])
    out = out.select("id", "text", "marked", "h1", "h2", "h3", "h4", F.regexp_count("marked", F.lit(_MARK)).cast("long").alias("n"))
    held = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | held | (F.pmod("h3", F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod("h4", F.lit(100)) < spm_rate, "spm").otherwise("psm")
    cuts = [F.pmod(h, F.col("n") + 1) for h in ("h1", "h2")]
    out = out.select("id", "text", "n", form.alias("form"), _index(F.col("marked"), F.col("n")).alias("units"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    head = _index(F.col("units"), F.col("b"))  # substring_index of no unit is empty
    out = out.select(
        "id",
        "text",
        "n",
        "form",
        unescape(_index(F.col("units"), F.col("a"))).alias("prefix"),
        unescape(_index(head, F.col("a") - F.col("b"))).alias("middle"),
        unescape(_index(F.col("units"), F.col("b") - F.col("n"))).alias("suffix"),
    )
    size = lambda part: F.when(F.col("form") != "plain", F.length(part).cast("long"))
    output = assemble(F.col("form"), F.col("prefix"), F.col("middle"), F.col("suffix"), F.col("text"))
    return out.select(F.col("id").alias(id_column), "n", "form", size("prefix").alias("prefix_chars"), size("middle").alias("middle_chars"), output.alias("output"))


def report(df: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from it."""
    out = transform(df)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def oracle_sql() -> str:
    """The same rows in SQL, by lists of lines."""
    draw = lambda i: f"('0x' || substr(d, {8 * i + 1}, 8))::BIGINT"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS l, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, len(l) AS n, {draw(0)} % (len(l) + 1) AS x, {draw(1)} % (len(l) + 1) AS y, {draw(2)} % 100 AS r, {draw(3)} % 100 AS o FROM t),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR r >= {RATE} THEN 'plain' WHEN o < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, text, coalesce(array_to_string(l[1:a], ''), '') AS p, coalesce(array_to_string(l[a + 1:b], ''), '') AS m, coalesce(array_to_string(l[b + 1:], ''), '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
