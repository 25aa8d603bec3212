"""Writers of what the engine gives out."""

from __future__ import annotations

import hashlib
import hmac
import json
import random
import time
import uuid
from collections.abc import Callable
from datetime import date, datetime, timezone
from decimal import Decimal
from pathlib import PurePath

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.verdicts import exportable
from . import joined
from .workbook import write_workbook  # noqa: F401  one of the writers


def write_transcripts(df: DataFrame, path: str) -> None:
    """One row per call, in folders by the first two hex digits of the name's hash."""
    df.withColumn("part", F.substring(F.sha2("filename", 256), 1, 2)).write.mode("overwrite").partitionBy("part").parquet(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """A table as CSV with headings; Spark's committer publishes it whole or not at all."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_evaluations(df: DataFrame, path: str) -> None:
    """Evaluations as JSON lines, without what must not leave the engine."""
    exportable(df).write.mode("overwrite").json(path)


def write_document(df: DataFrame, path: str, model: str, generated: str) -> None:
    """JSON lines under `evaluations`, and one line of `metadata` beside them.

    The evaluations are not gathered into one document, which would have to fit one task.
    """
    evaluations = exportable(df)
    evaluations.write.mode("overwrite").json(f"{path}/evaluations")
    cost = F.coalesce(F.sum(F.col("cost_usd").cast("decimal(18,6)")), F.lit(0)).cast("double")
    evaluations.agg(F.lit(generated).alias("generated"), F.lit(model).alias("model"), F.count("*").alias("calls"), cost.alias("cost_usd")).write.mode("overwrite").json(f"{path}/metadata")


def write_json_document(df: DataFrame, path: str, model: str, generated: str, order: list[str] | None = None) -> dict:
    """One JSON file of all evaluations and, after them, their metadata; returns the metadata.

    Tasks write the evaluations, each with the separator after it, and the file system joins
    the parts in order (sources.joined), so no task and no process holds the document. The
    numbers of the metadata are observed while the parts are written, not counted again;
    that is why they come last.
    """
    rows = exportable(df)
    rows = rows.orderBy(*order) if order else rows
    seen = Observation()
    cost = F.coalesce(F.sum(F.col("cost_usd").cast("decimal(18,6)")), F.lit(0)).cast("double")
    lines = rows.observe(seen, F.count(F.lit(1)).alias("calls"), cost.alias("cost_usd"))
    spark, folder, mark = df.sparkSession, f"{path}.parts-{uuid.uuid4().hex}", ",\n"
    try:
        lines.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value")).write.option("lineSep", mark).text(folder)
        parts = joined.parts_of(spark, folder)
        if parts:  # the last evaluation has none after it
            parts[-1] = (parts[-1][0], parts[-1][1] - len(mark))
        metadata = {"generated": generated, "model": model, **(seen.get if parts else {"calls": 0, "cost_usd": 0.0})}
        joined.join(spark, [b'{"evaluations": [\n', *parts, f'\n], "metadata": {json.dumps(metadata, ensure_ascii=False)}}}\n'.encode()], path)
    finally:
        joined.delete(spark, folder)
    return metadata


def plain(value: object) -> object:
    """What a value that JSON does not know is written as: paths and times as text, sets
    sorted, numbers of other libraries as numbers, bytes as UTF-8. Others are an error."""
    if isinstance(value, PurePath):
        return str(value)
    if isinstance(value, date):  # a datetime is one too
        return value.isoformat()
    if isinstance(value, (set, frozenset)):
        return sorted(value)
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    if hasattr(value, "tolist") and type(value).__module__.startswith("numpy"):
        return value.tolist()
    raise TypeError(f"{type(value).__name__} has no JSON form")


def emit_metric(path: str, event: str, **data: object) -> bool:
    """Append one event to a local metric log; False instead of an error if that fails."""
    row = {"timestamp": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "event": event, **data}
    try:
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(row, default=plain) + "\n")
    except (OSError, TypeError):
        return False
    return True


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def signature(payload: dict, secret: str) -> str:
    """HMAC-SHA256 of a payload with sorted keys."""
    return hmac.new(secret.encode(), json.dumps(payload, sort_keys=True).encode(), hashlib.sha256).hexdigest()


def notify(payload: dict, secret: str, post: Callable[[bytes, dict], int], tries: int = 3, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> bool:
    """Post a signed payload until a 2xx answer, waiting 2, 4, at most 8 seconds, give or
    take a quarter. post(body, headers) returns the status or raises OSError."""
    body = json.dumps(payload, sort_keys=True).encode()
    headers = {"Content-Type": "application/json", "X-Signature": signature(payload, secret)}
    rng = rng or random.Random()
    for n in range(tries):
        try:
            if 200 <= post(body, headers) < 300:
                return True
        except OSError:
            pass
        if n + 1 < tries:
            sleep(max(0.1, min(8, 2 ** (n + 1)) * (1 + rng.uniform(-0.25, 0.25))))
    return False
