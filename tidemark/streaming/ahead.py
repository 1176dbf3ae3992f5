"""Rows that a stream's state keeps until the watermark has passed them, given back in order.

What comes is cut into pieces that are sorted in themselves, each one value of a
map state under the order of its first row. Giving back merges pieces by these
keys, so a task holds some pieces at once and never all that waits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

#: Rows that are sorted at once on arrival, and rows of a piece.
RUN, PIECE = 1 << 19, 1 << 13


class Ahead:
    """order: whole-number columns, the first of them seconds; schema: all columns that are kept."""

    def __init__(self, handle: StatefulProcessorHandle, order: tuple[str, ...], schema: pa.Schema):
        self.order, self.schema = order, schema
        self.pieces = handle.getMapState("ahead", ", ".join(f"{c} long" for c in (*order, "piece")), "rows binary")
        self.first: int | None = None

    def add(self, frames: Iterator[pd.DataFrame]) -> None:
        held, n = [], 0
        for f in frames:
            f = f.assign(**{c: f[c].fillna(0).astype("int64") for c in self.order})
            held.append(pa.Table.from_pandas(f, self.schema, preserve_index=False))
            n += len(f)
            if n >= RUN:
                self._put(held)
                held, n = [], 0
        self._put(held)

    def due(self, now: int) -> Iterator[pa.Table]:
        """All rows up to now in order, taken out of the state; first is then the time of the first row that is left."""
        keys = sorted(self.pieces.keys())
        left = [k[0] for k in keys if k[0] > now][:1]
        keys = keys[: len(keys) - sum(k[0] > now for k in keys)]
        held = self.schema.empty_table()
        while keys:
            tables, n = [held], 0
            while keys and n <= len(held):  # as many rows as are held already, so that none is sorted over and over
                tables.append(self._take(keys.pop(0)))
                n += len(tables[-1])
            held = self._sorted(tables)
            ready = pc.sum(self._before(held, keys[0]) if keys else pc.less_equal(held[self.order[0]], now)).as_py() or 0
            for i in range(0, ready, PIECE):
                yield held.slice(i, min(PIECE, ready - i))
            held = held.slice(ready)
        self._put([held])
        self.first = min([*held[self.order[0]][:1].to_pylist(), *left], default=None)

    def _sorted(self, tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).sort_by([(c, "ascending") for c in self.order])

    def _before(self, rows: pa.Table, key: tuple) -> pa.ChunkedArray:
        """Which rows come before a piece's first."""
        out = None
        for c, x in reversed(list(zip(self.order, key, strict=False))):
            less = pc.less(rows[c], x)
            out = less if out is None else pc.or_(less, pc.and_(pc.equal(rows[c], x), out))
        return out

    def _put(self, tables: list[pa.Table]) -> None:
        if not sum(map(len, tables)):
            return
        rows = self._sorted(tables)
        for i in range(0, len(rows), PIECE):
            piece, n = rows.slice(i, PIECE), 0
            at = tuple(piece[c][0].as_py() for c in self.order)
            while self.pieces.containsKey((*at, n)):
                n += 1
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(piece.combine_chunks())
            self.pieces.updateValue((*at, n), (sink.getvalue().to_pybytes(),))

    def _take(self, key: tuple) -> pa.Table:
        rows = pa.ipc.open_stream(self.pieces.getValue(key)[0]).read_all()
        self.pieces.removeKey(key)
        return rows
