"""The call-record service as a Spark source: days and agents are pushed into its searches.

A search asks for a range of days and, if wanted, one agent, and gets at most `limit`
records. Spark plans no more than ranges of days. Each is a task of its own, and halves its
range as long as a search comes back full, down to single days; so nothing is counted
beforehand, and no record passes the driver. A single day that is still full is marked
`truncated`.

    register(spark)
    spark.read.format("calls").option("path", folder).load().where("day >= DATE '2024-01-01' AND agent_id = 7")
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import rules

RECORD = "id string, day date, agent_id long, flight_request_id long, started_at string, duration int, direction string, result string, recording_url string, agent_name string, client_name string, flight_request_status string"
_LAYOUT = pa.schema([
    ("id", pa.string()), ("day", pa.date32()), ("agent_id", pa.int64()), ("flight_request_id", pa.int64()), ("started_at", pa.string()), ("duration", pa.int32()), ("direction", pa.string()),
    ("result", pa.string()), ("recording_url", pa.string()), ("agent_name", pa.string()), ("client_name", pa.string()), ("flight_request_status", pa.string()),
])

#: Halvings within a task. Its range has at most two to this power of days, so that single days are reached.
DEPTH = rules.SPLIT_DEPTH


class Folder:
    """A service whose records are Parquet files in folders of months, ordered by day and id.

    Another service is a class with the same two methods, to be named in the option
    `service` as module:class and made from the options.
    """

    def __init__(self, options: dict[str, str]):
        self._fs, self._root = pafs.FileSystem.from_uri(options["path"]) if "://" in options["path"] or options["path"].startswith("file:") else (pafs.LocalFileSystem(), options["path"])
        self._months: dict[str, list[str]] = {}

    def bounds(self) -> tuple[date, date] | None:
        """First and last day that there may be records of, by the folders' names alone."""
        found = self._fs.get_file_info(pafs.FileSelector(self._root, allow_not_found=True))
        months = sorted(m[1] for f in found if (m := re.search(r"month=(\d{4}-\d{2})$", f.path)))
        if not months:
            return None
        year, month = map(int, months[-1].split("-"))
        return date.fromisoformat(f"{months[0]}-01"), date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)

    def _files(self, month: str) -> list[str]:
        """Files of a month, in the order of their records; listed once a task."""
        if month not in self._months:
            listed = self._fs.get_file_info(pafs.FileSelector(f"{self._root}/month={month}", allow_not_found=True))
            self._months[month] = sorted(f.path for f in listed if f.path.endswith(".parquet"))
        return self._months[month]

    def search(self, first: date, last: date, agent: int | None, limit: int) -> pa.Table:
        """At most `limit` records of a range of days; of a single day those of the smallest ids."""
        months = sorted({f"{d.year:04}-{d.month:02}" for d in (first + timedelta(days=i) for i in range((last - first).days + 1))})
        files = [f for m in months for f in self._files(m)]
        if not files:
            return _LAYOUT.empty_table()
        wanted = (pc.field("day") >= pa.scalar(first)) & (pc.field("day") <= pa.scalar(last))
        if agent is not None:
            wanted &= pc.field("agent_id") == agent
        records = ds.dataset(files, schema=_LAYOUT, format="parquet", filesystem=self._fs)
        if first < last:  # only whether it is full matters, if it is
            return records.head(limit, filter=wanted)
        return records.to_table(filter=wanted).sort_by("id").slice(0, limit)


def write_folder(records: DataFrame, path: str) -> None:
    """Records (RECORD) as a folder that Folder reads; a range sort, so that a busy month is many files."""
    columns = [f.split()[0] for f in RECORD.split(", ")]
    ordered = records.select(*columns).repartitionByRange("day", "id").sortWithinPartitions("day", "id")
    ordered.withColumn("month", F.date_format("day", "yyyy-MM")).write.partitionBy("month").parquet(path)


def halved(service, first: date, last: date, agent: int | None, limit: int, depth: int = DEPTH) -> Iterator[tuple[pa.Table, bool]]:
    """The records of a range, in parts that are not full, each with whether it is cut short.

    A full range is halved at its middle day, at most depth times; a single day is not.
    """
    found = service.search(first, last, agent, limit)
    days = (last - first).days
    if found.num_rows < limit or depth == 0 or days < 1:
        yield found, found.num_rows >= limit
        return
    middle = first + timedelta(days=days // 2)
    yield from halved(service, first, middle, agent, limit, depth - 1)
    yield from halved(service, middle + timedelta(days=1), last, agent, limit, depth - 1)


def distinct_first(parts: Iterable[tuple[pa.Table, bool]]) -> Iterator[pa.RecordBatch]:
    """Batches of the parts, the first record of each id, with `truncated` beside them.

    The ids of a task are held: it has at most limit times its days.
    """
    seen: set[str] = set()
    for table, cut in parts:
        keep = []
        for i in table.column("id").to_pylist():
            keep.append(i is None or i not in seen)
            seen.add(i)
        table = table.filter(pa.array(keep, pa.bool_()))
        yield from table.append_column("truncated", pa.array([cut] * table.num_rows, pa.bool_())).combine_chunks().to_batches()


@dataclass
class _Range(InputPartition):
    first: date
    last: date
    agent: int | None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.limit, self.first, self.last = int(options.get("limit", rules.API_LIMIT)), options.get("from"), options.get("to")
        self.first, self.last = self.first and date.fromisoformat(self.first), self.last and date.fromisoformat(self.last)
        self.agents: list[int] | None = None

    def _service(self):
        where, _, name = self.options.get("service", "").partition(":")
        if not where:
            return Folder(self.options)
        import importlib

        return getattr(importlib.import_module(where), name)(self.options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            one = timedelta(days=1)
            if column == ("day",) and isinstance(value, date) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = value + one if isinstance(f, GreaterThan) else value
                    self.first = max(self.first or low, low)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = value - one if isinstance(f, LessThan) else value
                    self.last = min(self.last or high, high)
            elif column == ("agent_id",) and isinstance(f, (EqualTo, In)) and value is not None:
                asked = {v for v in (value if isinstance(f, In) else [value]) if v is not None}
                self.agents = sorted(asked if self.agents is None else asked & set(self.agents))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Ranges of equally many days; no record is looked at."""
        known = None if self.first and self.last else self._service().bounds()
        if known is None and not (self.first and self.last):
            return [_Range(date(1970, 1, 2), date(1970, 1, 1), None)]
        first, last, step = self.first or known[0], self.last or known[1], timedelta(days=1 << DEPTH)
        out: list[InputPartition] = []
        for agent in [None] if self.agents is None else self.agents:
            at = first
            while at <= last:
                out.append(_Range(at, min(last, at + step - timedelta(days=1)), agent))
                at += step
        return out or [_Range(date(1970, 1, 2), date(1970, 1, 1), None)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.first <= partition.last:
            yield from distinct_first(halved(self._service(), partition.first, partition.last, partition.agent, self.limit))


class CallSource(DataSource):
    """Options: path (of the folder), limit (of a search), from and to (days), service."""

    @classmethod
    def name(cls) -> str:
        return "calls"

    def schema(self) -> str:
        return RECORD + ", truncated boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format `calls` known, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CallSource)
