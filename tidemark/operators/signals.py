"""Scored signals on trigger bars in the context of primary bars (SIG)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.plans.joins import as_of

TREND_BAND = 0.0001


def _closes(win: str) -> Column:
    return F.transform(win, lambda b: b["close"])


def primary_context(primary: DataFrame, primary_seconds: int, trigger_seconds: int) -> DataFrame:
    """One row of features a primary bar, and from which trigger bar on it is known (SIG2).

    A bar is known once it has closed: at the trigger bar that closes with it.
    """
    p = I.sliding(primary, I.PRIMARY_SLICE)
    c = _closes("win")
    p = p.withColumns({"n5": F.size("win"), "e9": I.ema(c, 9), "e21": I.ema(c, 21), "e50": I.ema(c, 50), "rsi5": I.rsi(c), "atr5": I.atr(F.col("win")), "h5": I.pivot_prices(F.col("win"), "high"), "l5": I.pivot_prices(F.col("win"), "low")})
    p = p.withColumn("structure5", I.structure(F.col("win"), F.col("h5"), F.col("l5")))
    up = (F.col("e9") > F.col("e21") * (1 + TREND_BAND)) & (F.col("e50").isNull() | (F.col("e21") > F.col("e50")))
    down = (F.col("e9") < F.col("e21") * (1 - TREND_BAND)) & (F.col("e50").isNull() | (F.col("e21") < F.col("e50")))
    trend = F.when(up & (F.col("structure5") == "BULLISH"), "BULLISH").when(down & (F.col("structure5") == "BEARISH"), "BEARISH").otherwise("RANGE")
    return p.select("symbol", (F.col("epoch_s") + primary_seconds - trigger_seconds).alias("known_s"), trend.alias("trend"), "structure5", "n5", F.col("e9").alias("ema9_5"), F.col("e21").alias("ema21_5"), F.col("e50").alias("ema50_5"), "rsi5", "atr5")


def features(trigger: DataFrame, primary: DataFrame, trigger_seconds: int, primary_seconds: int) -> DataFrame:
    """Trigger bars with their own indicators and those of the last closed primary bars (SIG6, SIG7)."""
    t = I.sliding(trigger, I.TRIGGER_SLICE)
    c = _closes("win")
    w = F.col("win")
    t = t.withColumns({"n1": F.size("win"), "ema9": I.ema(c, 9), "ema21": I.ema(c, 21), "ema50": I.ema(c, 50), "rsi": I.rsi(c), "macd": I.macd(c), "atr": I.atr(w), "vwap": I.vwap(w), "highs": I.pivot_prices(w, "high"), "lows": I.pivot_prices(w, "low")})
    t = t.withColumns({"structure": I.structure(w, F.col("highs"), F.col("lows")), "clusters": I.levels(F.col("highs"), F.col("lows"), F.col("close"), F.col("atr"))}).drop("win", "highs", "lows")
    t = t.withColumns({"supports": I.nearest(F.col("clusters"), F.col("close"), True), "resistances": I.nearest(F.col("clusters"), F.col("close"), False)}).drop("clusters")
    context = primary_context(primary, primary_seconds, trigger_seconds)
    values = [x for x in context.columns if x not in ("symbol", "known_s")]
    return as_of(t, context, ["symbol"], "epoch_s", "known_s", values)


def _side(long_: bool) -> dict[str, tuple[Column, int]]:
    """The scoring rules of one direction (SIG3): name -> condition and weight."""
    want, other = ("BULLISH", "BEARISH") if long_ else ("BEARISH", "BULLISH")
    unit = F.when(F.coalesce("atr", F.lit(0.0)) > 0, F.col("atr")).otherwise(1.0)
    below, above = F.col("close") - F.try_element_at("supports", F.lit(1))["price"], F.try_element_at("resistances", F.lit(1))["price"] - F.col("close")
    near, against = (below, above) if long_ else (above, below)
    more = (lambda a, b: a > b) if long_ else (lambda a, b: a < b)
    hist = F.col("macd.hist")
    low, high, far = (40.0, 68.0, F.col("rsi") > 70) if long_ else (32.0, 60.0, F.col("rsi") < 30)
    return {
        "trend": (F.col("trend") == want, 2),
        "average_cross": (more(F.col("ema9"), F.col("ema21")), 1),
        "structure": (F.col("structure") == want, 2),
        "structure_against": (F.col("structure") == other, -2),
        "momentum": (more(hist, F.lit(0.0)), 1),
        "strength_zone": (F.col("rsi").between(low, high), 1),
        "strength_extreme": (far, -1),
        "level_near": (near <= unit * 1.5, 1),
        "volatility": (F.col("atr") >= 0.25, 1),
        "above_average" if long_ else "below_average": ((F.col("close") >= F.col("ema21")) if long_ else (F.col("close") <= F.col("ema21")), 1),
        "level_against": (against < unit * 0.4, -1),
    }


def _score(rules: dict[str, tuple[Column, int]], without: frozenset[str]) -> Column:
    total = F.lit(0)
    for name, (c, weight) in rules.items():
        if name not in without:
            total = total + F.when(c, weight).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(10), total))


def score(rows: DataFrame, threshold: int = 7, without: frozenset[str] = frozenset()) -> DataFrame:
    """features() with scores, type, strength, reasons and warnings (SIG1, SIG3-5).

    Too little history is WAIT with strength 0. without leaves rules out, as in
    an ablation (EXP4).
    """
    long_, short = _side(True), _side(False)
    named = lambda rules, sign: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, (c, w) in rules.items() if w * sign > 0 and n not in without]))
    s = rows.withColumns({"long_score": _score(long_, without), "short_score": _score(short, without), "_lr": named(long_, 1), "_lw": named(long_, -1), "_sr": named(short, 1), "_sw": named(short, -1)})
    few = (F.col("n1") < 30) | F.col("n5").isNull() | (F.col("n5") < 15) | (F.col("close") <= 0)
    is_long = ~few & (F.col("long_score") >= threshold) & (F.col("trend") == "BULLISH") & (F.col("long_score") > F.col("short_score"))
    is_short = ~few & (F.col("short_score") >= threshold) & (F.col("trend") == "BEARISH") & (F.col("short_score") > F.col("long_score"))
    none = F.array().cast("array<string>")
    return s.withColumns(
        {
            "type": F.when(is_long, "LONG_SETUP").when(is_short, "SHORT_SETUP").otherwise("WAIT"),
            "strength": F.when(few, 0).otherwise(F.when(is_long, F.col("long_score")).when(is_short, F.col("short_score")).otherwise(F.greatest("long_score", "short_score"))),
            "reasons": F.when(few, F.array(F.lit("insufficient_history"))).when(is_long, F.col("_lr")).when(is_short, F.col("_sr")).when(F.col("trend") == "RANGE", F.array(F.lit("range"))).otherwise(F.array(F.lit("below_threshold"))),
            "warnings": F.when(few, none).when(is_long | (~is_short & (F.col("trend") == "BULLISH")), F.col("_lw")).when(is_short | (F.col("trend") == "BEARISH"), F.col("_sw")).otherwise(none),
        }
    ).drop("_lr", "_lw", "_sr", "_sw")


def components(rows: DataFrame) -> DataFrame:
    """features() rows with a direction, and for it the seven parts of a score as flags (CLS8). What is unknown is false, but the close stands in for a missing average."""
    long_ = F.col("direction") == "LONG"
    side = lambda up, down: F.coalesce(F.when(long_, up).otherwise(down), F.lit(False))
    unit = F.coalesce("atr", F.lit(1.5)) * 1.5
    support, resistance = (F.try_element_at(c, F.lit(1))["price"] for c in ("supports", "resistances"))
    hist, average, close = F.col("macd.hist"), F.coalesce("ema21", "close"), F.col("close")
    return rows.withColumns(
        {
            "has_trend": side(F.col("trend") == "BULLISH", F.col("trend") == "BEARISH"),
            "has_structure": side(F.col("structure") == "BULLISH", F.col("structure") == "BEARISH"),
            "has_cross": side(F.col("ema9") > F.col("ema21"), F.col("ema9") < F.col("ema21")),
            "has_momentum": side(hist > 0, hist < 0),
            "has_strength": side(F.col("rsi").between(40, 68), F.col("rsi").between(32, 60)),
            "has_level": side(close - support <= unit, resistance - close <= unit),
            "has_side": side(close >= average, close <= average),
        }
    )


def signals(scored: DataFrame, *more: str) -> DataFrame:
    """What replay needs of the setups (SIG7): the last bar of a history gives none, and a missing ATR is 1.5."""
    s = scored.where("type <> 'WAIT'")
    return s.select("symbol", F.col("epoch_s").alias("signal_time"), F.when(F.col("type") == "LONG_SETUP", "LONG").otherwise("SHORT").alias("direction"), "strength", F.coalesce("atr", F.lit(1.5)).alias("atr"), "trend", F.col("close").alias("signal_close"), F.col("high").alias("signal_high"), F.col("low").alias("signal_low"), "ema21", *more)


def regime(rows: DataFrame) -> DataFrame:
    """Overextension, ATR regime and a tag for each bar (SIG8)."""
    unit = F.greatest(F.lit(0.1), F.coalesce("atr", F.lit(1.5)))
    far = F.abs(F.col("close") - F.col("ema50_5")) / unit
    level = F.when(F.col("atr") < 0.75, "LOW").when(F.col("atr") <= 2.0, "NORMAL").otherwise("HIGH")
    tag = F.when(far > 2, "VOLATILITY_EXPANSION").when(F.col("trend").isin("BULLISH", "BEARISH"), "TREND_STRONG").otherwise("RANGE_COMPRESSION")
    return rows.withColumns({"distance": F.round(far, 4), "overextended": F.coalesce(far > 2, F.lit(False)), "atr_regime": level, "regime": tag})


def score_v2(rows: DataFrame, threshold: float = 7.5) -> DataFrame:
    """The second scoring, with clearance and body, over regime() rows (SIG9, SIG10); no level is a clearance of 999."""
    r = regime(rows)
    unit = F.greatest(F.lit(0.1), F.coalesce("atr", F.lit(1.5)))
    clear = lambda levels, sign: F.coalesce(sign * (F.try_element_at(levels, F.lit(1))["price"] - F.col("close")) / unit, F.lit(999.0))
    width = F.greatest(F.lit(0.01), F.col("high") - F.col("low"))
    out = {}
    for side, want, other, room, sign in (("long", "BULLISH", "BEARISH", clear("resistances", 1), 1), ("short", "BEARISH", "BULLISH", clear("supports", -1), -1)):
        d = sign * (F.col("close") - F.col("ema21")) / unit
        body = sign * (F.col("close") - F.col("open")) / width
        parts = [
            F.when(F.col("trend") == want, 2.5),
            F.when(F.col("structure") == want, 2.0).when(F.col("structure") == other, -2.0),
            F.when((d >= 0) & (d <= 0.75), 2.0).when(d > 1.2, -1.0),
            F.when(room >= 0.75, 1.5).otherwise(-1.5),
            F.when(body >= 0.5, 1.0),
            F.when(F.col("atr") >= 1.0, 1.0),
            F.when(F.col("overextended"), -2.0),
        ]
        total = F.lit(0.0)
        for p in parts:
            total = total + F.coalesce(p, F.lit(0.0))
        out[f"{side}_v2"] = F.greatest(F.lit(0.0), F.least(F.lit(10.0), total))
    r = r.withColumns(out)
    setup = F.when((F.col("long_v2") >= threshold) & (F.col("trend") == "BULLISH") & (F.col("long_v2") > F.col("short_v2")), "LONG_SETUP").when((F.col("short_v2") >= threshold) & (F.col("trend") == "BEARISH") & (F.col("short_v2") > F.col("long_v2")), "SHORT_SETUP").otherwise("WAIT")
    return r.withColumns({"type_v2": setup, "strength_v2": F.bround(F.greatest("long_v2", "short_v2"), 0).cast("int")})
