"""Ticks of a stored table as a Python data source: read by ranges, or replayed as a stream (SRC3, SRC5, STR1).

    spark.dataSource.register(TickSource)
    spark.read.format("ticks").options(path=..., start=..., end=..., days=7).load()
    spark.readStream.format("ticks").options(path=..., start=..., end=..., step=86400).load()

The table has event_id, ts, event_type and value. A range is an input partition,
which reads the row groups that may hold it; times are seconds since 1970. A path
is anything that pyarrow's file systems open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.sources.files import chunks

SCHEMA = "chunk int, symbol string, ts timestamp, seq long, price double"


@dataclass
class Range(InputPartition):
    """Ticks from lo to before hi."""

    chunk: int
    lo: int
    hi: int


def ticks_of(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    import pyarrow.dataset as ds

    table = ds.dataset(path.removeprefix("file://"))
    kind = table.schema.field("ts").type
    at = lambda s: pa.scalar(datetime.fromtimestamp(s, UTC).replace(tzinfo=None if kind.tz is None else UTC), kind)
    inside = (ds.field("ts") >= at(part.lo)) & (ds.field("ts") < at(part.hi))
    for b in table.to_batches(columns=["event_type", "ts", "event_id", "value"], filter=inside):
        if b.num_rows:
            ts = b.column(1).cast(pa.timestamp("us", kind.tz)).cast(pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([pa.array([part.chunk] * b.num_rows, pa.int32()), b.column(0).cast(pa.string()), ts, b.column(2).cast(pa.int64()), b.column(3).cast(pa.float64())], names=["chunk", "symbol", "ts", "seq", "price"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Range]:
        o = self.options
        return [Range(*c) for c in chunks(int(o["start"]), int(o["end"]), int(o.get("days", 7)), int(o.get("overlap", 3600)))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return ticks_of(self.options["path"], partition)


class _Stream(DataSourceStreamReader):
    """An offset is the time up to which all ticks were given."""

    def __init__(self, options: dict):
        self.options = options
        self.step = int(options.get("step", 0))
        self.at = int(options["start"])

    def initialOffset(self) -> dict:
        return {"until": int(self.options["start"])}

    def latestOffset(self) -> dict:
        end = int(self.options["end"])
        self.at = min(self.at + self.step, end) if self.step else end
        return {"until": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = max(self.at, end["until"])  # after a restart the checkpoint knows better
        width = int(float(self.options.get("days", 7)) * 86400)
        return [Range(0, t, min(t + width, end["until"])) for t in range(start["until"], end["until"], width)] or [Range(0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return ticks_of(self.options["path"], partition)

    def commit(self, end: dict) -> None:
        """Nothing is held back for offsets that are done: the table stays."""


class TickSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ticks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Stream(dict(self.options))
