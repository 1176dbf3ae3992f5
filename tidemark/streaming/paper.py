"""Paper trading as a stateful stream (STR5-8): signals and ticks of a symbol in, journal rows out.

Each symbol has one slot: free, waiting for a pull-back, or in a trade. Prices
are mirrored for short trades, so there is one set of rules. Rows wait in the
state until the watermark has passed them and are then taken in order of time,
those of an instant ticks first, so the journal does not depend on how rows
arrive in batches. Time limits are timers: a signal that no tick of its last
instant has filled is given up the instant after, and a trade that outlives its
limit is closed at the last price before it. A tick of the very instant is
looked at first. What waits is kept as sorted pieces, and a signal's id until the
watermark has passed its instant, as no row of that instant can come after it.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.session import typed_state
from tidemark.streaming.ahead import Ahead

JOURNAL = "symbol string, signal_time long, direction string, state string, at long, entry_price double, exit_price double, result string, r_multiple double, entry_time long, mfe_r double, mae_r double"
INPUT = "symbol string, ts timestamp, kind string, seq long, bid double, ask double, direction string, strength int, price double, atr double"


@dataclass(frozen=True)
class Rules:
    threshold: int = 7
    pull_back: float = 0.15
    give_up: float = 0.75
    wait_s: int = 120
    hold_s: int = 3600
    stop_atr: float = 1.0
    target1_atr: float = 1.0
    target2_atr: float = 2.0
    least_stop: float = 0.5
    remember_s: int = 7 * 86400


class Slot:
    """The slot of one symbol: what waits, what is traded, the ids that were seen, and the last bid and ask."""

    def __init__(self, symbol: str, rules: Rules, state: dict | None = None):
        self.symbol, self.rules = symbol, rules
        self.state = state or {"waiting": None, "trade": None, "seen": OrderedDict(), "last": None}

    def deadline(self) -> int | None:
        """The instant at which what waits is given up, or the trade expires."""
        if self.state["waiting"]:
            return self.state["waiting"]["time"] + self.rules.wait_s + 1
        return self.state["trade"]["entry_time"] + self.rules.hold_s if self.state["trade"] else None

    def until(self, t: int) -> list[dict]:
        """What time alone does before an instant."""
        at = self.deadline()
        if at is None or at >= t:
            return []
        if self.state["waiting"]:
            s, self.state["waiting"] = self.state["waiting"], None
            return [self._row(s, "TIMED_OUT", at)]
        bid, ask = self.state["last"]
        return self._closed("EXPIRED", at, bid if self.state["trade"]["sign"] > 0 else -ask)

    def _row(self, s: dict, state: str, at: int, **more: object) -> dict:
        row = dict.fromkeys(x.split()[0] for x in JOURNAL.split(", "))
        return row | {"symbol": self.symbol, "signal_time": s["time"], "direction": s["direction"], "state": state, "at": at} | more

    def signal(self, t: int, direction: str, strength: int, price: float, atr: float | None) -> list[dict]:
        r = self.rules
        if direction not in ("LONG", "SHORT") or strength is None or strength < r.threshold:
            return []
        seen = self.state["seen"]
        while seen and next(iter(seen))[0] < t - r.remember_s:
            seen.popitem(last=False)
        if (t, direction) in seen:
            return []
        seen[(t, direction)] = None
        s = {"time": t, "direction": direction, "atr": atr or 1.5}
        if self.state["waiting"] or self.state["trade"]:
            return [self._row(s, "CONCURRENCY_BLOCKED", t)]
        sign = 1 if direction == "LONG" else -1
        s |= {"sign": sign, "target": round(sign * price - round(r.pull_back * s["atr"], 2), 2), "floor": round(sign * price - round(r.give_up * s["atr"], 2), 2)}
        self.state["waiting"] = s
        return []

    def tick(self, t: int, bid: float, ask: float) -> list[dict]:
        self.state["last"] = (bid, ask)
        return self._waiting(t, bid, ask) if self.state["waiting"] else self._trading(t, bid, ask) if self.state["trade"] else []

    def _waiting(self, t: int, bid: float, ask: float) -> list[dict]:
        s, r = self.state["waiting"], self.rules
        x = bid if s["sign"] > 0 else -ask
        if x <= s["floor"]:
            self.state["waiting"] = None
            return [self._row(s, "INVALIDATED", t)]
        if x <= s["target"]:
            entry = round(min(s["target"], x) + round(ask - bid, 2), 2)
            dist = max(r.least_stop, round(s["atr"] * r.stop_atr, 2))
            self.state["waiting"] = None
            self.state["trade"] = s | {"entry": entry, "entry_time": t, "dist": dist, "stop": round(entry - dist, 2), "one": round(entry + round(s["atr"] * r.target1_atr, 2), 2), "two": round(entry + round(s["atr"] * r.target2_atr, 2), 2), "mfe": 0.0, "mae": 0.0}
            return []  # exits begin with the next tick
        if t - s["time"] > r.wait_s:
            self.state["waiting"] = None
            return [self._row(s, "TIMED_OUT", t)]
        return []

    def _closed(self, result: str, t: int, price: float) -> list[dict]:
        s, self.state["trade"] = self.state["trade"], None
        return [self._row(s, "CLOSED", t, entry_price=s["sign"] * s["entry"], exit_price=s["sign"] * price, result=result, r_multiple=round((price - s["entry"]) / s["dist"], 2), entry_time=s["entry_time"], mfe_r=round(s["mfe"] / s["dist"], 3), mae_r=round(s["mae"] / s["dist"], 3))]

    def _trading(self, t: int, bid: float, ask: float) -> list[dict]:
        s = self.state["trade"]
        x = bid if s["sign"] > 0 else -ask
        s["mfe"], s["mae"] = max(s["mfe"], x - s["entry"]), max(s["mae"], s["entry"] - x)
        for result, hit, price in (("STOP_LOSS", x <= s["stop"], s["stop"]), ("TP2", x >= s["two"], s["two"]), ("TP1", x >= s["one"], s["one"]), ("EXPIRED", t - s["entry_time"] >= self.rules.hold_s, x)):
            if hit:
                return self._closed(result, t, price)
        return []


_OPEN = "time long, direction string, atr double, sign int, target double, floor double"
_ROW = pa.schema({"ts": pa.int64(), "rank": pa.int64(), "seq": pa.int64(), "bid": pa.float64(), "ask": pa.float64(), "direction": pa.string(), "strength": pa.int32(), "price": pa.float64(), "atr": pa.float64()})
_TRADE = _OPEN + ", entry double, entry_time long, dist double, stop double, one double, two double, mfe double, mae double"


_KINDS = {"long": int, "int": int, "double": float, "string": str}


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class PaperTrader(StatefulProcessor):
    """Slots in typed state: what waits and what is traded as values, rows ahead of the watermark as a list, seen ids as a map."""

    def __init__(self, rules: Rules = Rules()):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.trade = handle.getValueState("waiting", _OPEN), handle.getValueState("trade", _TRADE)
        self.last = handle.getValueState("last", "bid double, ask double")
        self.ahead = Ahead(handle, ("ts", "rank", "seq"), _ROW)
        self.seen = handle.getMapState("seen", "time long, direction string", "at long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        """Take up an open trade or a waiting signal of an earlier run: a row of _TRADE columns, entry null while it waits."""
        for row in initialState.to_dict("records"):
            waits = pd.isna(row.get("entry"))
            schema, state = (_OPEN, self.waiting) if waits else (_TRADE, self.trade)
            state.update(tuple(_KINDS[x.split()[1]](row[x.split()[0]]) for x in schema.split(", ")))
            self.seen.updateValue((int(row["time"]), row["direction"]), (int(row["time"]),))
            at = int(row["time"]) + self.rules.wait_s + 1 if waits else int(row["entry_time"]) + self.rules.hold_s
            if not waits:
                self.last.update((row["sign"] * row["entry"], row["sign"] * row["entry"]))
            self.handle.registerTimer((at + 1) * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        self.ahead.add(f.assign(ts=f.ts.astype("datetime64[s]").astype("int64"), rank=(f.kind != "tick").astype("int64")) for f in rows)
        yield from self._upto(key[0], timerValues.getCurrentWatermarkInMs() // 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield from self._upto(key[0], timerValues.getCurrentWatermarkInMs() // 1000)

    def _upto(self, symbol: str, now: int) -> Iterator[pd.DataFrame]:
        """Take the rows up to an instant, then what time alone does by then, and set a timer for what is next."""
        one = lambda state, schema: dict(zip(_names(schema), state.get(), strict=True)) if state.exists() else None
        before = {(int(t), d) for t, d in self.seen.keys()}
        slot = Slot(symbol, self.rules, {"waiting": one(self.waiting, _OPEN), "trade": one(self.trade, _TRADE), "seen": OrderedDict.fromkeys(sorted(before)), "last": self.last.get() if self.last.exists() else None})
        for rows in self.ahead.due(now):
            out: list[dict] = []
            for ts, rank, bid, ask, direction, strength, price, atr in zip(*(rows[n].to_pylist() for n in _ROW.names if n != "seq"), strict=True):
                out += slot.until(ts)
                out += slot.signal(ts, direction, strength, price, atr) if rank else slot.tick(ts, bid, ask)
            slot.state["seen"] = OrderedDict.fromkeys(k for k in slot.state["seen"] if k[0] >= ts)
            if out:
                yield pd.DataFrame(out)
        out = slot.until(now + 1)
        slot.state["seen"] = OrderedDict.fromkeys(k for k in slot.state["seen"] if k[0] >= now)
        self._store(slot.state, before)
        nexts = [x for x in (self.ahead.first, slot.deadline()) if x is not None]
        if nexts:
            self.handle.registerTimer(max(min(nexts), now + 1) * 1000)
        if out:
            yield pd.DataFrame(out)

    def _store(self, state: dict, before: set) -> None:
        for name, schema, to in (("waiting", _OPEN, self.waiting), ("trade", _TRADE, self.trade)):
            to.update(tuple(state[name][n] for n in _names(schema))) if state[name] else to.clear()
        if state["last"]:
            self.last.update(tuple(state["last"]))
        now = set(state["seen"])
        for k in now - before:
            self.seen.updateValue(k, (k[0],))
        for k in before - now:
            self.seen.removeKey(k)

    def close(self) -> None:
        pass


def journal(rows: DataFrame, rules: Rules = Rules(), late: str = "0 seconds", initial: DataFrame | None = None) -> DataFrame:
    """The journal of a stream of INPUT rows (kind tick or signal), one slot a symbol (STR5-8).

    Rows later than the watermark (late behind the newest row) are dropped. The
    state survives in the checkpoint; initial gives what was open before the
    first run (symbol and the columns of _TRADE).
    """
    typed_state(rows.sparkSession)
    dealt = rows.withWatermark("ts", late).groupBy("symbol")
    first = initial.groupBy("symbol") if initial is not None else None
    return dealt.transformWithStateInPandas(PaperTrader(rules), JOURNAL, "Append", "EventTime", initialState=first)


def epochs(journal_rows: DataFrame, since: int, last: int = 100) -> DataFrame:
    """The latest journal rows since a time, newest first (STR10)."""
    return journal_rows.where(F.col("at") >= since).orderBy(F.desc("at"), F.desc("signal_time")).limit(last)
