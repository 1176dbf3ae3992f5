"""Indicators that are kept up to date tick by tick (STR3, STR4): typed state instead of arrays of bars.

Per symbol the state holds the bar that is being made, what the recursive
averages need of all closed bars (a few numbers each), the last analysis, and
the ticks that the watermark has not passed yet. Ticks are taken in order of
event time, so a late tick within the watermark changes its own bar.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.session import typed_state
from tidemark.streaming.ahead import Ahead
from tidemark.streaming.bars import changed

ANALYSIS = "symbol string, at long, price double, bar_time long, ema9 double, ema21 double, ema50 double, rsi double, atr double"
_BAR = "bar_time long, high double, low double, close double"
_SUMS = "n long, bar_time long, close double, ema9 double, ema21 double, ema50 double, up double, down double, tr double"
_TICK = pa.schema({"ts": pa.int64(), "seq": pa.int64(), "price": pa.float64()})
SPANS = (9, 21, 50)


@dataclass(frozen=True)
class Throttle:
    """A new analysis at a new bar, or after wait seconds and a move of step."""

    wait: float = 1.5
    step: float = 0.10


def closed(sums: dict, high: float, low: float, close: float, n: int = 14) -> dict:
    """What the averages need after one more closed bar; an average of fewer than n values is their sum so far."""
    i, was = sums["n"] + 1, sums["close"]
    out = {"n": i, "close": close}
    for k in SPANS:
        e = sums[f"ema{k}"]
        out[f"ema{k}"] = e + close if i < k else (e + close) / k if i == k else close * 2 / (k + 1) + e * (1 - 2 / (k + 1))
    step = close - was if i > 1 else 0.0
    tr = high - low if i == 1 else max(high - low, abs(high - was), abs(low - was))

    def wilder(a: float, x: float, seen: int) -> float:
        return a + x if seen < n else (a + x) / n if seen == n else (a * (n - 1) + x) / n

    out |= {"up": wilder(sums["up"], max(step, 0.0), i - 1) if i > 1 else 0.0, "down": wilder(sums["down"], max(-step, 0.0), i - 1) if i > 1 else 0.0}
    return out | {"tr": wilder(sums["tr"], tr, i)}


def shown(sums: dict, n: int = 14) -> dict:
    """The indicators as they are given out; null while there are too few bars."""
    i = sums["n"]
    rsi = None if i <= n else 100.0 if sums["down"] == 0 else round(100 - 100 / (1 + sums["up"] / sums["down"]), 2)
    return {f"ema{k}": round(sums[f"ema{k}"], 4) if i >= k else None for k in SPANS} | {"rsi": rsi, "atr": round(sums["tr"], 4) if i > n else None}


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class LiveIndicators(StatefulProcessor):
    def __init__(self, seconds: int, throttle: Throttle):
        self.seconds, self.throttle = seconds, throttle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = Ahead(handle, ("ts", "seq"), _TICK)
        self.bar, self.sums = handle.getValueState("bar", _BAR), handle.getValueState("sums", _SUMS)
        self.analysed = handle.getValueState("analysed", "at long, price double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        self.ahead.add(f.assign(ts=f.ts.astype("datetime64[s]").astype("int64")) for f in rows)
        yield from self._upto(key[0], timerValues.getCurrentWatermarkInMs() // 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield from self._upto(key[0], timerValues.getCurrentWatermarkInMs() // 1000)

    def _upto(self, symbol: str, now: int) -> Iterator[pd.DataFrame]:
        bar = dict(zip(_names(_BAR), self.bar.get(), strict=True)) if self.bar.exists() else None
        sums = dict(zip(_names(_SUMS), self.sums.get(), strict=True)) if self.sums.exists() else {"n": 0, "bar_time": 0} | dict.fromkeys(_names(_SUMS)[2:], 0.0)
        before = dict(zip(("at", "price"), self.analysed.get(), strict=True)) if self.analysed.exists() else {}
        for rows in self.ahead.due(now):
            out = []
            for t, price in zip(rows["ts"].to_pylist(), rows["price"].to_numpy().tolist(), strict=True):
                of = t - t % self.seconds
                new = bar is None or of > bar["bar_time"]
                if new:
                    if bar:
                        sums = closed(sums, bar["high"], bar["low"], bar["close"]) | {"bar_time": bar["bar_time"]}
                    bar = {"bar_time": of, "high": price, "low": price, "close": price}
                else:
                    bar |= {"high": max(bar["high"], price), "low": min(bar["low"], price), "close": price}
                if changed(before, price, t, new, self.throttle.wait, self.throttle.step):
                    before = {"at": t, "price": price}
                    out.append({"symbol": symbol, "at": t, "price": price, "bar_time": sums["bar_time"] if sums["n"] else None} | shown(sums))
            if out:
                yield pd.DataFrame(out).astype({"bar_time": "Int64"})
        if self.ahead.first is not None:
            self.handle.registerTimer(max(self.ahead.first, now + 1) * 1000)
        if bar:
            self.bar.update(tuple(bar.values()))
            self.sums.update(tuple(sums[n] for n in _names(_SUMS)))
        if before:
            self.analysed.update((before["at"], before["price"]))

    def close(self) -> None:
        pass


def analyses(ticks: DataFrame, seconds: int = 60, throttle: Throttle = Throttle(), late: str = "5 minutes") -> DataFrame:
    """The analyses of a stream of (symbol, ts, seq, price) ticks: at a tick that calls for one, the indicators of all closed bars.

    Averages run over the whole series, as ema_series has them. Rows later than
    the watermark are dropped; state survives in the checkpoint.
    """
    typed_state(ticks.sparkSession)
    rows = ticks.select("symbol", "ts", "seq", "price").withWatermark("ts", late)
    return rows.groupBy("symbol").transformWithStateInPandas(LiveIndicators(seconds, throttle), ANALYSIS, "Append", "EventTime")
