"""Entry policies: when and at what price a signal is entered over the bars that follow (ENT).

All work in mirrored prices, in which a short trade is a long one: prices are
multiplied by +1 or -1, and highs and lows change places. A policy looks at a
bounded number of next bars of one signal and nothing else, so it is an array
expression; there is no state across signals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.slices import halo, own


def with_path(signals: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    """Signals with path, an array of the next n bars in mirrored prices (t, o, h, l, c) with the spread (s, null if not known); signals on a last bar go.

    Next bars are next by position, across gaps.
    """
    spread = F.col("spread").cast("double") if "spread" in bars.columns else F.lit(None).cast("double")
    rows, keys = halo(bars.select("symbol", "epoch_s", "open", "high", "low", "close", spread.alias("spread")), ["symbol"], ["epoch_s"], 0, n)
    ahead = Window.partitionBy(*keys).orderBy("epoch_s").rowsBetween(1, n)
    b = own(rows.withColumn("_next", F.collect_list(F.struct("epoch_s", "open", "high", "low", "close", "spread")).over(ahead))).select("symbol", F.col("epoch_s").alias("signal_time"), "_next")
    s = signals.join(b, ["symbol", "signal_time"]).where(F.size("_next") > 0).withColumn("sign", F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0))
    sign = F.col("sign")
    mirrored = F.transform("_next", lambda x: F.struct(x["epoch_s"].alias("t"), (sign * x["open"]).alias("o"), F.when(sign > 0, x["high"]).otherwise(-x["low"]).alias("h"), F.when(sign > 0, x["low"]).otherwise(-x["high"]).alias("l"), (sign * x["close"]).alias("c"), x["spread"].alias("s")))
    s = s.withColumn("path", mirrored).drop("_next")
    return s.withColumns({"_ref": sign * F.col("signal_close"), "_top": F.when(sign > 0, F.col("signal_high")).otherwise(-F.col("signal_low")), "_bottom": F.when(sign > 0, F.col("signal_low")).otherwise(-F.col("signal_high"))})


@dataclass(frozen=True)
class Policy:
    """A named policy of at most wait bars: evaluate gives a struct (status, k, price) in mirrored prices."""

    name: str
    wait: int
    evaluate: Callable[[bool], Column]


def _first(wait: int, judge: Callable[[Column], Column]) -> Column:
    """The first of wait bars for which judge gives a struct (status, price); else timed out, or waiting at the data's end."""
    seen = F.filter(F.transform(F.slice("path", 1, wait), lambda b, i: F.struct(judge(b).alias("x"), (i + 1).alias("k"))), lambda y: y["x"].isNotNull())
    hit = F.try_element_at(seen, F.lit(1))
    none = F.struct(F.when(F.size("path") >= wait, "TIMED_OUT").otherwise("WAITING").alias("status"), F.least(F.size("path"), F.lit(wait)).alias("k"), F.lit(None).cast("double").alias("price"))
    return F.when(hit.isNotNull(), F.struct(hit["x"]["status"].alias("status"), hit["k"].alias("k"), hit["x"]["price"].alias("price"))).otherwise(none)


def _judge(wait: int, invalid: Callable[[Column], Column], fills: list[tuple[Callable[[Column], Column], Callable[[Column], Column]]], causal: bool, gapped: Callable[[Column], Column] | None = None) -> Column:
    """Invalidation and fills of each bar in order.

    A path from the reference must cross the fill level before the deeper
    invalidation level; causal tests it so, unless the bar opens beyond (gapped).
    Otherwise whole bars are tested for invalidation first.
    """
    no_price = F.lit(None).cast("double")
    out_of = F.struct(F.lit("INVALIDATED").alias("status"), no_price.alias("price"))

    def judge(b: Column) -> Column:
        first = gapped(b) if causal and gapped is not None else invalid(b)
        out = F.when(first, out_of)
        for hit, price in fills:
            out = out.when(hit(b), F.struct(F.lit("ENTERED").alias("status"), F.round(price(b), 2).alias("price")))
        return out.when(invalid(b), out_of)

    return _first(wait, judge)


def _atr(x: float) -> Column:
    return F.round(F.col("atr") * x, 2)


def immediate() -> Policy:
    """The next bar's open (ENT1)."""
    return Policy("immediate", 1, lambda causal: F.struct(F.lit("ENTERED").alias("status"), F.lit(1).alias("k"), F.round(F.try_element_at("path", F.lit(1))["o"], 2).alias("price")))


def retrace(atr: float = 0.25, wait: int = 3, invalid: float = 1.0, name: str = "retrace") -> Policy:
    """A pull-back of some ATR, given up at a deeper level (ENT2); with 0.15, 2 and 0.75 the tight one (ENT7)."""
    target, floor = F.round(F.col("_ref") - _atr(atr), 2), F.round(F.col("_ref") - F.col("atr") * invalid, 2)
    return Policy(name, wait, lambda causal: _judge(wait, lambda b: b["l"] <= floor, [(lambda b: b["l"] <= target, lambda b: F.least(target, b["o"]))], causal, lambda b: b["o"] <= floor))


def tight() -> Policy:
    return retrace(0.15, 2, 0.75, "tight")


def reversion(wait: int = 5, invalid: float = 1.2) -> Policy:
    """A touch of the 21-bar average (ENT3)."""
    target, floor = F.col("sign") * F.coalesce("ema21", "signal_close"), F.col("_ref") - F.col("atr") * invalid
    return Policy("reversion", wait, lambda causal: _judge(wait, lambda b: b["l"] <= floor, [(lambda b: b["l"] <= target, lambda b: F.least(target, b["o"]))], causal, lambda b: b["o"] <= floor))


def breakout(atr: float = 0.20, wait: int = 2) -> Policy:
    """A break of the signal bar's extreme; its other extreme, strictly, gives up (ENT5)."""
    target = F.round(F.col("_top") + _atr(atr), 2)
    return Policy("breakout", wait, lambda causal: _judge(wait, lambda b: b["l"] < F.col("_bottom"), [(lambda b: b["h"] >= target, lambda b: F.greatest(target, b["o"]))], False))


def hybrid(back: float = 0.20, ahead: float = 0.20, wait: int = 3, invalid: float = 0.9) -> Policy:
    """Pull-back or break, the pull-back first within a bar (ENT6)."""
    low, high, floor = F.round(F.col("_ref") - _atr(back), 2), F.round(F.col("_top") + _atr(ahead), 2), F.round(F.col("_ref") - F.col("atr") * invalid, 2)
    fills = [(lambda b: b["l"] <= low, lambda b: F.least(low, b["o"])), (lambda b: b["h"] >= high, lambda b: F.greatest(high, b["o"]))]
    return Policy("hybrid", wait, lambda causal: _judge(wait, lambda b: b["l"] <= floor, fills, causal, lambda b: b["o"] <= floor))


def momentum() -> Policy:
    """One bar must close its way and break the signal bar's extreme; entered at the open after it (ENT4)."""
    one, two = F.try_element_at("path", F.lit(1)), F.try_element_at("path", F.lit(2))
    good = (one["c"] > one["o"]) & (one["h"] > F.col("_top"))
    status = F.when(two.isNull(), "WAITING").when(good, "ENTERED").otherwise("INVALIDATED")
    return Policy("momentum", 2, lambda causal: F.struct(status.alias("status"), F.least(F.size("path"), F.lit(2)).alias("k"), F.when(status == "ENTERED", F.round(two["o"], 2)).alias("price")))


def random_delay(seed: int = 42, most: int = 3) -> Policy:
    """A control: the open of one of the next bars, drawn by a hash of seed, symbol and time (ENT8)."""
    k = (F.pmod(F.xxhash64(F.lit(seed), "symbol", "signal_time"), F.lit(most)) + 1).cast("int")
    at = F.try_element_at("path", k)
    return Policy("random_delay", most, lambda causal: F.struct(F.when(at.isNull(), "WAITING").otherwise("ENTERED").alias("status"), F.least(F.size("path"), k).alias("k"), F.round(at["o"], 2).alias("price")))


POLICIES = (immediate, retrace, reversion, momentum, breakout, hybrid, tight, random_delay)


def evaluate(paths: DataFrame, policy: Policy, causal: bool = True, spread: Callable[[Column], Column] | float = 0.3) -> DataFrame:
    """Signals of with_path() with status, entry_k (bar of the decision), entry_time and entry_price (with the spread paid)."""
    e = paths.withColumn("_e", policy.evaluate(causal))
    entered = F.col("_e.status") == "ENTERED"
    now = entered & (F.col("_e.k") == 1) & (F.try_element_at("path", F.lit(1))["o"] <= F.col("_e.price")) if policy.name in ("retrace", "reversion") else entered & (F.lit(policy.name) == "immediate")
    status = F.when(now, "ENTERED_IMMEDIATELY").when(entered, "ENTERED_AFTER_DELAY").otherwise(F.col("_e.status"))
    at = F.try_element_at("path", F.col("_e.k").cast("int"))
    spread = F.lit(spread) if isinstance(spread, float) else spread(at)
    return e.withColumns({"policy": F.lit(policy.name), "status": status, "entry_k": F.col("_e.k").cast("int"), "decided_time": at["t"], "entry_time": F.when(entered, at["t"]), "entry_price": F.when(entered, F.round(F.col("sign") * (F.col("_e.price") + spread), 2))}).drop("_e")
