"""Keyed result stores as Parquet tables, and the small driver-side helpers around them."""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cache
from .commits import CommitLog, Conflict

#: What may be kept of an evaluation, and what must be there to use it.
LLM_COLUMNS = [
    "criteria", "overall_assessment", "strengths", "improvements", "critical_gaps", "call_type", "model_used", "provider_used",
    "tokens_used", "cost_usd", "eval_time_seconds", "is_followup", "truncated", "prompt_hash", "criteria_version",
]
LLM_REQUIRED = ["criteria", "overall_assessment"]
STT_REQUIRED = ["text", "raw_text"]

#: Folders that each commit's rows are dealt to by key, so that a lookup reads only those of its keys.
PARTS = 64


def allowed(rows: DataFrame, columns: list[str] | None) -> DataFrame:
    """rows (key, cached_at, ..) with the columns that may be kept."""
    return rows.select(*[c for c in rows.columns if c in ("key", "cached_at") or columns is None or c in columns])


class Store:
    """A table of results by key, for any number of writers at once. put() appends; of a key's
    entries the newest counts.

    Rows lie in one folder for each put() or compact(), within it in folders of parts by the
    key's hash. A log of commits (commits.CommitLog) names the folders that count, so readers
    see the table after some commit, whole, and a crash leaves at most a folder that no
    commit names. compact() replaces the folders that it has read, and those alone: rows
    that were put meanwhile stay. If another compact() or clear() was faster, it begins anew.
    Replaced folders stay for those that still read them, until the next compact(), unless clear() takes them.
    """

    def __init__(self, spark: SparkSession, path: str, ttl_days: int, required: list[str], columns: list[str] | None = None, max_entries: int = 0, parts: int = PARTS):
        self.spark, self.path, self.ttl_days, self.required, self.columns, self.max_entries, self.parts = spark, path.rstrip("/"), ttl_days, required, columns, max_entries, parts
        self.log = CommitLog(spark, self.path)

    def current(self) -> int:
        """Number of the commit that counts."""
        return self.log.latest()[0]

    def exists(self) -> bool:
        return bool(self.log.latest()[1]["live"])

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame) -> str:
        """rows in a folder of their own, which no commit names yet."""
        name = uuid.uuid4().hex
        rows.withColumn("part", self.part(F.col("key"))).hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.path}/data/commit={name}")
        return name

    def _read(self, live: list[str]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], "key string, cached_at timestamp, part int")
        rows = self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", True).parquet(*[f"{self.path}/data/commit={c}" for c in live])
        return rows.drop("commit").withColumn("part", F.col("part").cast("int"))

    def _newest(self, rows: DataFrame, as_of: Any) -> DataFrame:
        known = [c for c in self.required if c in rows.columns]
        rows = cache.live(rows, as_of, self.ttl_days, known)
        return rows.groupBy("key").agg(F.max_by(F.struct(*rows.columns), "cached_at").alias("row")).select("row.*").drop("part")

    def _delete(self, folders: list[str]) -> None:
        for name in folders:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/commit={name}")
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def put(self, rows: DataFrame) -> int:
        """Append rows (key, cached_at, ..), without columns that are not on the list; returns the commit's number."""
        name = self._write(allowed(rows, self.columns))
        return self.log.commit(lambda now: {"live": [*now["live"], name], "removed": [], "kind": "put"})

    def entries(self, as_of: Any) -> DataFrame:
        """Live entries, one per key."""
        return self._newest(self._read(self.log.latest()[1]["live"]), as_of)

    def lookup(self, requests: DataFrame, as_of: Any) -> DataFrame:
        """requests (key, ..) with `hit` and the live entry's columns; reads only the parts of their keys.

        Which parts these are is at most `parts` numbers, which the driver puts into the read.
        """
        touched = [r[0] for r in requests.select(self.part(F.col("key")).alias("p")).distinct().collect()]
        rows = self._read(self.log.latest()[1]["live"]).where(F.col("part").isin(touched))
        return cache.lookup(requests, self._newest(rows, as_of))

    def size(self) -> int:
        return self._read(self.log.latest()[1]["live"]).select("key").distinct().count()

    def compact(self, as_of: Any, current: DataFrame | None = None, tries: int = 5) -> int:
        """Rewrite the table with what is still of use; returns the number of entries.

        Orphans go first, so that they take no place of the max_entries that stay.
        """
        for _ in range(tries):
            began, state = self.log.latest()
            read = state["live"]
            if not read:
                return 0
            name = None
            try:
                rows = self._newest(self._read(read), as_of)
                if current is not None:
                    rows = rows.join(current.select("key").distinct(), "key", "left_semi")
                name = self._write(cache.newest(rows, self.max_entries))
                version = self.log.commit(lambda now, name=name, read=read: {"live": [name, *_without(now["live"], read)], "removed": read, "kind": "compact"})
            except Exception as e:
                if name:
                    self._delete([name])
                if isinstance(e, Conflict) or not set(read) <= set(self.log.latest()[1]["live"]):
                    continue  # what was read is gone, and may have been while it was read
                raise
            done = [v for v in self.log.versions() if v < version]
            self._delete([f for v in done for f in self.log.read(v)["removed"]])
            self.log.trim(began)
            return self.size()
        raise Conflict(f"another writer was faster {tries} times")

    def clear(self, dry_run: bool = False) -> int:
        """Delete the table's rows; with dry_run only say how many entries would go."""
        n = self.size()
        if not dry_run and self.exists():
            version = self.log.commit(lambda now: {"live": [], "removed": now["live"], "kind": "clear"})
            self._delete(self.log.read(version)["removed"])
        return n

    def vacuum(self, older_than_s: float = 86_400.0) -> int:
        """Delete folders that no commit names and that are older than a day: what crashed writers left."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        named = {f for v in self.log.versions() for s in [self.log.read(v)] for f in (*s["live"], *s["removed"])}
        left = [s.getPath().getName().removeprefix("commit=") for s in (fs.listStatus(root) if fs.exists(root) else []) if time.time() - s.getModificationTime() / 1000 > older_than_s]
        gone = [f for f in left if f not in named]
        self._delete(gone)
        return len(gone)


def _without(live: list[str], read: list[str]) -> list[str]:
    """What is live besides the folders that were read; all of these must still be."""
    if not set(read) <= set(live):
        raise Conflict("the folders that were read have been replaced")
    return [f for f in live if f not in set(read)]


class Recent:
    """The most recently used values of a driver, at most `most` of them."""

    def __init__(self, most: int = 128):
        self.most, self._held = max(1, most), OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: Hashable, make: Callable[[], Any]) -> Any:
        if key in self._held:
            self.hits += 1
            self._held.move_to_end(key)
            return self._held[key]
        self.misses += 1
        value = self._held[key] = make()
        if len(self._held) > self.most:
            self._held.popitem(last=False)
        return value


class Templates:
    """Prompt templates of a folder, read once."""

    def __init__(self, folder: str):
        self.folder, self._recent = folder, Recent()

    def load(self, name: str) -> str:
        def read() -> str:
            with open(os.path.join(self.folder, f"{name}.txt"), encoding="utf-8") as f:
                return f.read()

        return self._recent.get(name, read)


class RunLock:
    """A file that keeps two runs on one host apart; stale after a day or with its process."""

    def __init__(self, path: str, max_age: float = 86_400.0):
        self.path, self.max_age = path, max_age

    def _stale(self) -> bool:
        try:
            with open(self.path, encoding="utf-8") as f:
                held = json.load(f)
            if time.time() - held["started_at"] > self.max_age:
                return True
            if held["host"] != socket.gethostname():
                return False
            os.kill(held["pid"], 0)
        except (ProcessLookupError, ValueError, KeyError):
            return True
        except PermissionError:
            return False
        return False

    def __enter__(self) -> RunLock:
        if os.path.exists(self.path) and self._stale():
            os.unlink(self.path)
        fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        with os.fdopen(fd, "w") as f:
            json.dump({"pid": os.getpid(), "host": socket.gethostname(), "started_at": time.time()}, f)
        return self

    def __exit__(self, *_: object) -> None:
        os.unlink(self.path)
