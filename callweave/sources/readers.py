"""Readers of what the engine takes in."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import megabytes
from ..functions.text import audio_error, audio_format, basename

PAYLOAD = (
    "success boolean, count int, message string, items array<struct<id:bigint,created_at:string,status:string,"
    "agent:struct<id:bigint,name:string,email:string>,client:struct<first_name:string,last_name:string,email:string,phone:string>,"
    "calls:array<struct<id:string,started_at:string,duration:int,direction:string,result:string,recording_url:string>>>>"
)
METRICS = "timestamp string, event string, evaluations int, avg_score double, llm_cost double, stt_cost double, total_cost double, provider string, reason string, error_type string, status_code int"
CRITERIA = "key string, category string, weight double, applicability string, description string, ordinal int"
AUDIO = ["mp3", "wav", "m4a", "flac", "ogg"]

_LOG = r"^(\S+ \S+) \[(\w+)\] (\S+) \[([^\]:]+):(\d+)\] (.*)$"
#: What a record of the run log begins with.
_STAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\S* \["


def call_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of the call-record service, one JSON document per file."""
    return spark.read.schema(PAYLOAD).option("multiLine", True).json(path)


def metric_events(spark: SparkSession, path: str) -> DataFrame:
    """The metric log, one JSON object per line; broken lines are left out."""
    return spark.read.schema(METRICS).option("mode", "DROPMALFORMED").json(path)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the run log in parts; what has no such form is message alone."""
    part = lambda i: F.nullif(F.regexp_extract("value", _LOG, i), F.lit(""))
    return spark.read.text(path).select(F.try_to_timestamp(part(1)).alias("ts"), part(2).alias("level"), part(3).alias("logger"), part(4).alias("file"), part(5).cast("int").alias("line"), F.coalesce(part(6), "value").alias("message"))


def log_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the run log of any number of lines: file, place (of the first line), ts, level, logger, source, line, message, n_lines.

    A record begins at a line that begins with a stamp and goes on to the next one. Files
    are read in splits, each by itself; lines before the first stamp of a split belong to
    the last record of the splits before, which one row a split finds. Lines before the
    first stamp of a file are a record without a stamp, which is message alone.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), "value", F.col("value").rlike(_STAMP).cast("int").alias("begins")
    )
    inside = W.partitionBy("file", "split").orderBy("n")
    lines = lines.withColumn("record", F.sum("begins").over(inside))
    last = lines.groupBy("file", "split").agg(F.max("record").alias("last")).withColumn("_owner", F.when(F.col("last") > 0, F.struct("split", "last")))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(F.col("file").alias("_file"), F.col("split").alias("_split"), F.last("_owner", True).over(before).alias("_owner"))
    owned = lines.join(carried, (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split")), "left")
    at = F.when(F.col("record") > 0, F.struct("split", F.col("record").alias("last"))).otherwise(F.col("_owner"))
    whole = owned.groupBy("file", at.alias("at")).agg(F.array_sort(F.collect_list(F.struct("split", "n", "value"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    part = lambda i: F.nullif(F.regexp_extract("text", "(?s)" + _LOG, i), F.lit(""))
    found = whole.select("file", F.struct(F.get("lines", 0)["split"].alias("split"), F.get("lines", 0)["n"].alias("n")).alias("place"), text.alias("text"), F.size("lines").alias("n_lines"))
    message = F.when(F.col("text").rlike("(?s)" + _LOG), F.regexp_extract("text", "(?s)" + _LOG, 6)).otherwise(F.col("text"))
    return found.select("file", "place", F.try_to_timestamp(part(1)).alias("ts"), part(2).alias("level"), part(3).alias("logger"), part(4).alias("source"), part(5).cast("int").alias("line"), message.alias("message"), "n_lines")


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """Audio files of a folder, by name: name, path, size, size_mb.

    Contents are not read. Spark lists no empty files, so these never get further.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(AUDIO) + "}").load(folder)
    return listed.select(basename(F.col("path")).alias("name"), "path", F.col("length").alias("size"), megabytes(F.col("length")).alias("size_mb")).orderBy("name")


def audio_checks(spark: SparkSession, folder: str) -> DataFrame:
    """name, format and error of audio files, by their first bytes and size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(AUDIO) + "}").load(folder)
    return files.select(basename(F.col("path")).alias("name"), audio_format(F.col("content")).alias("format"), audio_error(F.col("content")).alias("error"))


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts of a folder, one text file each."""
    return spark.read.option("wholetext", True).text(folder).select(F.regexp_replace(basename(F.col("_metadata.file_path")), r"\.[^.]*$", "").alias("stem"), F.col("value").alias("transcript"))


def criteria(spark: SparkSession, config: dict[str, dict[str, dict[str, Any]]]) -> DataFrame:
    """The criteria dimension of a two-level mapping category -> key -> settings.

    Weight defaults to 1.0 and applicability to both; of a key that occurs in two
    categories the last one counts, in the first one's place.
    """
    flat: dict[str, tuple] = {}
    for category, entries in config.items():
        for key, c in entries.items():
            flat[key] = (key, category, float(c.get("weight", 1.0)), c.get("call_applicability", "both"), c.get("description", ""))
    return spark.createDataFrame([(*v, i) for i, v in enumerate(flat.values(), 1)], CRITERIA)


def load_config(path: str) -> dict:
    """A YAML file, on the driver; needs PyYAML."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def check_config(config: dict, sections: dict[str, list[str]]) -> list[str]:
    """What a configuration lacks: sections, and keys of sections."""
    lacking = [s for s in sections if not isinstance(config.get(s), dict)]
    return lacking + [f"{s}.{k}" for s, keys in sections.items() if s not in lacking for k in keys if k not in config[s]]
