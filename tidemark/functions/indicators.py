"""Indicators over windows of bars as array expressions (IND).

Recursive averages depend on where their slice begins, so each takes an array:
the bars of a sliding slice, or of a whole series. Each is one fold over it, on
the JVM; state is never rounded, results are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.slices import halo, own

#: Bars of a slice: trigger bars, primary bars.
TRIGGER_SLICE, PRIMARY_SLICE = 121, 60


def sliding(bars: DataFrame, n: int, name: str = "win", by: str = "symbol") -> DataFrame:
    """bars with an array of the last n bars, this one included, oldest first."""
    rows, keys = halo(bars, [by], ["epoch_s"], n - 1)
    w = Window.partitionBy(*keys).orderBy("epoch_s").rowsBetween(1 - n, 0)
    return own(rows.withColumn(name, F.collect_list(F.struct("epoch_s", "open", "high", "low", "close", F.col("tick_volume").cast("double").alias("volume"))).over(w)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once, however often use names it."""
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def _mean(values: Column, n: int) -> Column:
    return F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, x: a + x) / n


def _rest(values: Column, n: int) -> Column:
    return F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))


def ema(values: Column, n: int) -> Column:
    """Exponential average at the end of an array, seeded by the mean of its first n; null if it has fewer (IND1, IND2)."""
    k = 2.0 / (n + 1)
    fold = let(values, lambda v: F.when(F.size(v) >= n, F.aggregate(_rest(v, n), _mean(v, n), lambda a, x: x * k + a * (1 - k))))
    return F.round(fold, 4)


def ema_series(bars: DataFrame, n: int, value: str = "close", by: str = "symbol") -> DataFrame:
    """bars with the exponential average of the whole series so far (IND1).

    Every step maps the value before it to a * value + b: the first n steps sum,
    the next one turns the sum into the mean that seeds the rest. Such maps
    compose, so days are folded in parallel to one map each, the days of a key
    are scanned, and each day is folded again from what it starts with. What one
    task holds of a key is a row a day.
    """
    k = 2.0 / (n + 1)
    rows = bars.select(by, "epoch_s", F.col(value).cast("double").alias("v"), F.floor(F.col("epoch_s") / 86400).alias("day"))
    before = Window.partitionBy(by).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.groupBy(by, "day").agg(F.count(F.lit(1)).alias("m")).select(by, "day", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("seen"))
    days = rows.groupBy(by, "day").agg(F.array_sort(F.collect_list(F.struct("epoch_s", "v"))).alias("s")).join(seen, [by, "day"])

    def maps(x: Column, j: Column) -> Column:
        i = F.col("seen") + j + 1
        factor = F.when(i <= n, 1.0).when(i == n + 1, (1 - k) / n).otherwise(1 - k)
        return F.struct(x["epoch_s"].alias("t"), i.alias("i"), factor.alias("a"), F.when(i <= n, x["v"]).otherwise(x["v"] * k).alias("b"))

    days = days.select(by, "day", F.transform("s", maps).alias("maps"))
    whole = F.aggregate("maps", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), lambda c, x: F.struct((c["a"] * x["a"]).alias("a"), (c["b"] * x["a"] + x["b"]).alias("b")))
    none = F.struct(F.lit(0.0).alias("e"), F.array().cast("array<double>").alias("out"))
    step = lambda c, x: F.struct((c["e"] * x["a"] + x["b"]).alias("e"), F.array_append(c["out"], c["e"]).alias("out"))
    scan = days.select(by, "day", whole.alias("w")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("day", F.col("w.a").alias("a"), F.col("w.b").alias("b")))).alias("d"))
    starts = scan.select(by, F.explode(F.arrays_zip(F.transform("d", lambda x: x["day"]).alias("day"), F.aggregate("d", none, step)["out"].alias("e"))).alias("z")).select(by, "z.day", F.col("z.e").alias("start"))
    begun = F.struct(F.col("start").alias("e"), F.array().cast("array<double>").alias("out"))
    inside = lambda c, x: let(c["e"] * x["a"] + x["b"], lambda e: F.struct(e.alias("e"), F.array_append(c["out"], e).alias("out")))
    out = days.join(starts, [by, "day"]).select(by, F.explode(F.arrays_zip("maps", F.aggregate("maps", begun, inside)["out"].alias("e"))).alias("z"))
    average = F.when(F.col("z.maps.i") == n, F.col("z.e") / n).when(F.col("z.maps.i") > n, F.col("z.e"))
    return out.select(by, F.col("z.maps.t").alias("epoch_s"), F.round(average, 4).alias(f"ema{n}"))


def rsi(close: Column, n: int = 14) -> Column:
    """Wilder's relative strength at the end of an array; 100 if nothing fell; null for n values or fewer (IND3)."""
    wilder = lambda v: F.aggregate(_rest(v, n), _mean(v, n), lambda a, x: (a * (n - 1) + x) / n)
    steps = lambda c: F.zip_with(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), lambda x, y: x - y)
    means = lambda d: F.struct(wilder(F.transform(d, lambda x: F.greatest(x, F.lit(0.0)))).alias("up"), wilder(F.transform(d, lambda x: F.greatest(-x, F.lit(0.0)))).alias("down"))
    value = lambda m: F.when(m["down"] == 0, 100.0).otherwise(F.round(100 - 100 / (1 + m["up"] / m["down"]), 2))
    return let(close, lambda c: F.when(F.size(c) > n, let(let(steps(c), means), value)))


def macd(close: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """line, signal and histogram at the end of an array, null for fewer than slow + signal values (IND4).

    The line is the difference of rounded averages; all averages advance in one fold.
    """
    kf, ks, kg = 2.0 / (fast + 1), 2.0 / (slow + 1), 2.0 / (signal + 1)
    zero = F.lit(0.0)
    start = F.struct(F.lit(0).alias("i"), zero.alias("sum"), zero.alias("f"), zero.alias("s"), zero.alias("line"), zero.alias("lsum"), zero.alias("g"))

    def step(a: Column, x: Column) -> Column:
        i, total = a["i"] + 1, a["sum"] + x
        f = F.when(i == fast, total / fast).otherwise(x * kf + a["f"] * (1 - kf))
        s = F.when(i == slow, total / slow).otherwise(x * ks + a["s"] * (1 - ks))
        line = F.when(i >= slow, F.round(f, 4) - F.round(s, 4)).otherwise(zero)
        lsum = a["lsum"] + line
        seen = i - (slow - 1)
        g = F.when(seen == signal, lsum / signal).otherwise(line * kg + a["g"] * (1 - kg))
        return F.struct(i.alias("i"), total.alias("sum"), F.when(i < fast, zero).otherwise(f).alias("f"), F.when(i < slow, zero).otherwise(s).alias("s"), line.alias("line"), lsum.alias("lsum"), g.alias("g"))

    end = lambda a: F.struct(F.round(a["line"], 4).alias("macd"), F.round(F.round(a["g"], 4), 4).alias("signal"), F.round(a["line"] - F.round(a["g"], 4), 4).alias("hist"))
    return F.when(F.size(close) >= slow + signal, F.aggregate(close, start, step, end))


def true_range(win: Column) -> Column:
    """True ranges of an array of bars; the first is its own high - low."""
    return F.transform(win, lambda b, i: F.when(i == 0, b["high"] - b["low"]).otherwise(F.greatest(b["high"] - b["low"], F.abs(b["high"] - F.try_element_at(win, i)["close"]), F.abs(b["low"] - F.try_element_at(win, i)["close"]))))


def atr(win: Column, n: int = 14) -> Column:
    """Wilder's average true range at the end of an array of bars; null for n bars or fewer (IND5)."""
    return F.when(F.size(win) > n, F.round(let(true_range(win), lambda tr: F.aggregate(_rest(tr, n), _mean(tr, n), lambda a, x: (a * (n - 1) + x) / n)), 4))


def vwap(win: Column, digits: int = 2) -> Column:
    """Volume-weighted typical price of a whole slice; null without volume (IND6)."""
    total = F.aggregate(win, F.struct(F.lit(0.0).alias("pv"), F.lit(0.0).alias("v")), lambda a, b: F.struct((a["pv"] + F.when(b["volume"] > 0, (b["high"] + b["low"] + b["close"]) / 3 * b["volume"]).otherwise(0.0)).alias("pv"), (a["v"] + F.when(b["volume"] > 0, b["volume"]).otherwise(0.0)).alias("v")))
    return F.round(total["pv"] / F.nullif(total["v"], F.lit(0.0)), digits)


def pivots(bars: DataFrame, k: int = 2, by: str = "symbol") -> DataFrame:
    """bars with pivot_high and pivot_low (IND7): above all of the k bars before and not below any of the k after.

    A tie with an earlier bar disqualifies, with a later one does not; the first
    and last k bars are none.
    """
    rows, keys = halo(bars, [by], ["epoch_s"], k, k)
    w = Window.partitionBy(*keys).orderBy("epoch_s")
    before, after = w.rowsBetween(-k, -1), w.rowsBetween(1, k)
    whole = (F.count(F.lit(1)).over(before) == k) & (F.count(F.lit(1)).over(after) == k)
    high = whole & (F.max("high").over(before) < F.col("high")) & (F.max("high").over(after) <= F.col("high"))
    low = whole & (F.min("low").over(before) > F.col("low")) & (F.min("low").over(after) >= F.col("low"))
    return own(rows.withColumns({"pivot_high": high, "pivot_low": low}))


def pivot_prices(win: Column, field: str, k: int = 2) -> Column:
    """Prices of the pivots of an array of bars, oldest first."""
    sign = 1 if field == "high" else -1

    def found(v: Column) -> Column:
        at = lambda i: F.try_element_at(v, i)

        def is_pivot(i: Column) -> Column:
            ok = F.lit(True)
            for j in range(1, k + 1):
                ok = ok & (at(i) > at(i - j)) & (at(i) >= at(i + j))
            return ok

        places = F.filter(F.sequence(F.lit(k + 1), F.greatest(F.size(v) - k, F.lit(k + 1))), is_pivot)
        return F.transform(places, lambda i: sign * at(i))

    return F.when(F.size(win) >= 2 * k + 1, let(F.transform(win, lambda b: sign * b[field]), found)).otherwise(F.array().cast("array<double>"))


def structure(win: Column, highs: Column, lows: Column) -> Column:
    """BULLISH, BEARISH or RANGE from the last two pivots of either kind, else from the halves' means (IND8)."""
    n = F.size(win)
    hi, lo = F.array_max(F.transform(win, lambda b: b["high"])), F.array_min(F.transform(win, lambda b: b["low"]))
    mid = (hi + lo) / 2
    half = F.floor(n / 2).cast("int")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, b: s + b["close"]) / F.size(a)
    first, second = mean(F.slice(win, F.lit(1), F.greatest(half, F.lit(1)))), mean(F.slice(win, half + 1, F.greatest(n - half, F.lit(1))))
    h1, h0 = F.try_element_at(highs, F.lit(-1)), F.try_element_at(highs, F.lit(-2))
    l1, l0 = F.try_element_at(lows, F.lit(-1)), F.try_element_at(lows, F.lit(-2))
    few = (F.size(highs) < 2) | (F.size(lows) < 2)
    by_means = F.when(second > first * 1.002, "BULLISH").when(second < first * 0.998, "BEARISH").otherwise("RANGE")
    by_pivots = F.when((h1 > h0) & (l1 > l0), "BULLISH").when((h1 < h0) & (l1 < l0), "BEARISH").otherwise("RANGE")
    return F.when(n < 15, "RANGE").when((mid > 0) & ((hi - lo) / mid < 0.0015), "RANGE").when(few, by_means).otherwise(by_pivots)


def levels(highs: Column, lows: Column, price: Column, atr_: Column) -> Column:
    """Clusters of the last 15 pivots of either kind: array of (price, touches) (IND9).

    Each price joins the first cluster within the tolerance, whose price moves
    to the mean: the order of the fold matters.
    """
    last = lambda a: F.slice(a, F.greatest(F.size(a) - 14, F.lit(1)), F.lit(15))
    tolerance = F.when(atr_ > 0, atr_ * 0.4).otherwise(price * 0.0008)

    def add(c: Column, p: Column) -> Column:
        at = F.array_position(F.transform(c, lambda x: F.abs(x["price"] - p) <= tolerance), F.lit(True))
        moved = F.transform(c, lambda x, i: F.when(i + 1 == at, F.struct(F.round((x["price"] * x["touches"] + p) / (x["touches"] + 1), 2).alias("price"), (x["touches"] + 1).alias("touches"))).otherwise(x))
        return F.when(at > 0, moved).otherwise(F.concat(c, F.array(F.struct(F.round(p, 2).alias("price"), F.lit(1).alias("touches")))))

    return F.aggregate(F.concat(last(highs), last(lows)), F.array().cast("array<struct<price:double,touches:int>>"), add)


def nearest(clusters: Column, price: Column, below: bool, n: int = 4) -> Column:
    """Up to n levels strictly below (or above) a price, the nearest first, strength at most 5."""
    sign = -1 if below else 1
    kept = F.filter(clusters, lambda c: (c["price"] < price) if below else (c["price"] > price))
    key = F.transform(kept, lambda c: F.struct((sign * c["price"]).alias("k"), F.least(c["touches"], F.lit(5)).alias("strength")))
    return F.transform(F.slice(F.array_sort(key), 1, n), lambda x: F.struct((sign * x["k"]).alias("price"), F.lit("support" if below else "resistance").alias("type"), x["strength"].alias("strength")))
