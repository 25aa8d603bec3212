"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python worker. Documents can be long, so rows alone
#: would make the size of a batch depend on the data.
BATCH_BYTES = 4 << 20

#: Shuffle files go as soon as the query is done that wrote them, not when the driver's heap fills.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A side of at most so many bytes (as Spark counts a materialised row) may be broadcast.
BROADCAST_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where the setting is absent and Spark runs in this process (tests) is a folder of
    our own taken; on a cluster no folder of one machine would do, so that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = f"{tempfile.gettempdir()}/checkpoints/callweave-{uuid.uuid4().hex}"
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return at.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/callweave-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results read from them end too."""
    _delete(spark, run_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it again; this cuts its lineage.

    Lost executors then cost nothing: the files outlive them.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        # selected anew, so that the setting holds for this execution
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._callweave_path = path
    for scope in _SCOPES:
        scope.tables.append(out)
    return out


class intermediate:
    """Tables that are materialised in a with block of it are deleted at its end, but for those kept.

    Nothing that is read later may come from the others. Blocks may be nested; what the inner
    one keeps is the outer one's.
    """

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []
        self._kept: list[str] = []

    def keep(self, table: DataFrame) -> DataFrame:
        self._kept.append(table._callweave_path)
        return table

    def __enter__(self) -> intermediate:
        _SCOPES.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        _SCOPES.remove(self)
        discard(*[t for t in self.tables if t._callweave_path not in self._kept])


#: The open blocks of intermediate tables, outermost first.
_SCOPES: list[intermediate] = []


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() wrote."""
    for table in tables:
        path = getattr(table, "_callweave_path", None)
        if path:
            _delete(table.sparkSession, path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts; a smaller setting stays.

    Workers also learn where this package is, in case the driver runs in another folder.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") in ("-1", str(64 << 20)):  # Spark's defaults
        spark.conf.set(key, str(BATCH_BYTES))


#: What this Python worker keeps from one task to the next.
_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make gives, once for a Python worker; whatever it has kept under another key goes."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Drop what tasks of other operators have kept, and Arrow's spare memory. Workers are used
    again by later stages, which would else have the caches of earlier ones beside their own."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()  # caches of methods refer to their owners
    pa.default_memory_pool().release_unused()


def small_enough(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised table's rows, as text, take at most limit bytes."""
    width = [F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in table.columns]
    total = width[0]
    for w in width[1:]:
        total = total + w
    return (table.agg(F.sum(total.cast("long")).alias("n")).first()["n"] or 0) <= limit


def without(df: DataFrame, gone: DataFrame, id_column: str, column: str) -> DataFrame:
    """The rows of df whose id and text's hash are not among gone (id, hash), a materialised table.

    The columns of gone get names that df cannot have, so df's may have any. Null ids are
    equal to each other; null texts stay.
    """
    own = [f"_{uuid.uuid4().hex}" for _ in range(2)]
    side = gone.toDF(*own)
    side = F.broadcast(side) if small_enough(side) else side
    text = df[f"`{column}`"]
    return df.join(side, df[f"`{id_column}`"].eqNullSafe(side[own[0]]) & (F.xxhash64(text) == side[own[1]]), "left_anti")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
