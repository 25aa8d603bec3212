"""From timed words to speaker turns and silence statistics.

Words are rows (call_id, pos, text, speaker, type, start): type is word, punctuation or
spacing, start is in seconds and may be null. All windows are partitioned by call, so
the words are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.window import WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import exact_round
from ..functions.text import hold_language, strip

GAP_SECONDS = 30.0
SILENCE_MS = 1000
TOP_GAPS = 20


def _call() -> WindowSpec:
    return W.partitionBy("call_id")


def _order() -> WindowSpec:
    return _call().orderBy("pos")


def _upto() -> WindowSpec:
    return _order().rowsBetween(W.unboundedPreceding, 0)


def _before() -> WindowSpec:
    return _order().rowsBetween(W.unboundedPreceding, -1)


def gaps(words: DataFrame) -> DataFrame:
    """(call_id, pos, from_s, to_s, gap_ms) between starts of neighbouring timed words."""
    timed = words.where("type = 'word' and start is not null").withColumn("from_s", F.lag("start").over(_order()))
    return timed.where("from_s is not null").select("call_id", "pos", "from_s", F.col("start").alias("to_s"), ((F.col("start") - F.col("from_s")) * 1000).alias("gap_ms"))


def silence_stats(words: DataFrame) -> DataFrame:
    """Silence of each call that has a timed word: gaps of over a second, and the longest twenty."""
    timed = words.where("type = 'word' and start is not null").withColumn("from_s", F.lag("start").over(_order())).withColumn("gap_ms", (F.col("start") - F.col("from_s")) * 1000)
    ms = F.when(F.col("gap_ms") > SILENCE_MS, exact_round(F.col("gap_ms"), 0).cast("long"))
    timed = timed.withColumn("_ms", ms).withColumn("_rank", F.row_number().over(W.partitionBy("call_id").orderBy(F.desc_nulls_last("_ms"), "pos")))
    ms = F.col("_ms")
    gap = F.when(ms.isNotNull() & (F.col("_rank") <= TOP_GAPS), F.struct((-ms).alias("by"), F.col("pos").alias("pos"), exact_round(F.col("from_s"), 1).alias("start_s"), exact_round(F.col("start"), 1).alias("end_s"), ms.alias("duration_ms")))
    found = timed.groupBy("call_id").agg(
        F.coalesce(F.max(ms), F.lit(0)).alias("longest_gap_ms"),
        F.count_if(ms >= 30000).alias("num_gaps_over_30s"),
        F.coalesce(F.sum(ms), F.lit(0)).alias("total_silence_ms"),
        F.count(ms).alias("num_gaps"),
        F.max_by("start", "pos").alias("_end"),
        F.transform(F.array_sort(F.collect_list(gap)), lambda g: F.struct(g["start_s"], g["end_s"], g["duration_ms"])).alias("gap_locations"),
    )
    length = F.when(F.col("_end") > 0, F.col("_end") * 1000).otherwise(0.0)
    return found.withColumn("silence_pct", exact_round(F.col("total_silence_ms") / F.greatest(F.lit(1.0), length) * 100, 1)).drop("_end")


def no_silence() -> Column:
    """The statistics that stand in for a call whose words are not at hand."""
    return F.struct(
        F.lit(0.0).alias("silence_pct"), F.lit(0).alias("longest_gap_ms"), F.lit(0).alias("num_gaps_over_30s"), F.lit(0).alias("total_silence_ms"), F.lit(0).alias("num_gaps"),
        F.from_json(F.lit("[]"), "array<struct<start_s:double,end_s:double,duration_ms:bigint>>").alias("gap_locations"), F.lit(True).alias("_reconstructed"),
    )


def speaker_words(words: DataFrame) -> DataFrame:
    """(call_id, speaker, n) of words that have a speaker."""
    return words.where("type = 'word' and speaker is not null and speaker <> ''").groupBy("call_id", "speaker").agg(F.count("*").alias("n"))


def merge_minor(rows: DataFrame, counts: Column, keep_first: bool = False) -> DataFrame:
    """rows (call_id, pos, speaker, ..) with `effective`: minor speakers merged into two.

    In a call of more than two speakers that counts (1 or 0 for a row) says anything of,
    the two with the highest counts stay, the earlier one in a tie. Each other speaker
    becomes the major one heard last before its first row, else the first one heard.
    With keep_first the call's first speaker takes the second place if it has none.
    """
    known = F.col("speaker").isNotNull() & (F.col("speaker") != "")
    by = W.partitionBy("call_id", "speaker")
    rows = rows.withColumn("_n", F.when(known, F.sum(counts).over(by)).otherwise(-1)).withColumn("_first", F.when(known, F.min("pos").over(by)))
    rows = rows.withColumn("_rank", F.dense_rank().over(_call().orderBy(F.desc("_n"), F.asc_nulls_last("_first"))))
    rows = rows.withColumn("_many", F.max(F.when(F.col("_n") > 0, F.col("_rank"))).over(_call()))
    if keep_first:
        opening = F.col("_first") == F.min("_first").over(_call())
        rows = rows.withColumn("_opening_rank", F.max(F.when(opening, F.col("_rank"))).over(_call()))
        major = (F.col("_rank") == 1) | (F.col("_rank") == F.greatest(F.lit(2), F.col("_opening_rank")))
    else:
        major = F.col("_rank") <= 2
    rows = rows.withColumn("_major", F.when(known & major, F.col("speaker")))
    rows = rows.withColumn("_last", F.last("_major", True).over(_upto())).withColumn("_opening", F.first("_major", True).over(_order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    at_first = F.first("_last").over(by.orderBy("pos"))
    merged = F.when(~known | (F.coalesce("_many", F.lit(0)) <= 2) | F.col("_major").isNotNull(), F.col("speaker")).otherwise(F.coalesce(at_first, F.col("_opening")))
    return rows.withColumn("effective", merged).drop("_n", "_first", "_rank", "_many", "_opening_rank", "_major", "_last", "_opening")


def speaker_label(speaker: Column) -> Column:
    """speaker_3 as Speaker 3, no speaker as Speaker, anything else in title case."""
    numbered = F.regexp_extract(speaker, r"^[^_]*_(\d+)$", 1)
    return F.when(speaker.isNull() | (speaker == ""), "Speaker").when(numbered != "", F.concat(F.lit("Speaker "), numbered)).otherwise(F.initcap(F.replace(speaker, F.lit("_"), F.lit(" "))))


def build_lines(words: DataFrame, gap_seconds: float = GAP_SECONDS) -> DataFrame:
    """(call_id, line_no, line) of the diarised transcript of each call.

    A line ends where another speaker starts or a gap opens; words without a speaker
    stay with the current one. A gap is a line of its own, [M:SS silence], which says
    hold where the line before it uses hold language.
    """
    words = merge_minor(words, (F.col("type") == "word").cast("int"))
    timed = (F.col("type") == "word") & F.col("start").isNotNull()
    heard = F.when(F.col("effective") != "", F.col("effective"))
    words = words.withColumn("_gap", F.when(timed, F.col("start") - F.last(F.when(timed, F.col("start")), True).over(_before())))
    words = words.withColumn("_gap", F.when(F.col("_gap") >= gap_seconds, F.col("_gap")))
    words = words.withColumn("_heard", heard).withColumn("_current", F.last("_heard", True).over(_upto())).withColumn("_earlier", F.last("_heard", True).over(_before()))
    turn = F.col("_heard").isNotNull() & ~F.col("_heard").eqNullSafe(F.col("_earlier"))
    words = words.withColumn("_line", F.sum((turn | F.col("_gap").isNotNull()).cast("int")).over(_upto()))
    piece = F.struct("pos", F.when(F.col("type") == "spacing", " ").otherwise(F.coalesce("text", F.lit(""))).alias("t"))
    lines = words.groupBy("call_id", "_line").agg(
        F.max("_current").alias("_speaker"),
        F.max("_gap").alias("_gap"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), "").alias("_text"),
    )
    lines = lines.withColumn("line", F.concat(speaker_label(F.col("_speaker")), F.lit(": "), strip(F.col("_text"))))
    seconds = F.floor("_gap")
    held = F.coalesce(hold_language(F.lag("line").over(_call().orderBy("_line"))), F.lit(False))
    marker = F.concat(F.lit("["), F.format_string("%d:%02d", F.expr("cast(floor(_gap) as bigint) div 60"), seconds % 60), F.lit(" silence"), F.when(held, " — hold").otherwise(""), F.lit("]"))
    marked = lines.withColumn("_parts", F.when(F.col("_gap").isNotNull(), F.array(marker, F.col("line"))).otherwise(F.array("line")))
    return marked.select("call_id", "_line", F.posexplode("_parts").alias("_i", "line")).select("call_id", F.row_number().over(_call().orderBy("_line", "_i")).alias("line_no"), "line")


def transcripts(lines: DataFrame) -> DataFrame:
    """(call_id, transcript) of ordered lines."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("call_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("transcript"))


def split_lines(transcripts: DataFrame) -> DataFrame:
    """(call_id, line_no, line) of transcripts (call_id, transcript)."""
    return transcripts.select("call_id", F.posexplode(F.split("transcript", "\n")).alias("line_no", "line"))
