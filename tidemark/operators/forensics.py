"""What went wrong with trades: tags, contrasts, cubes, excursions, reconciliation (FOR, AUD, EXP5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.stats import _mean_h, _rate, loss, win
from tidemark.plans.joins import interval
from tidemark.plans.slices import halo, own


def _for(long_: Column, short: Column) -> Column:
    return F.coalesce(F.when(F.col("direction") == "LONG", long_).otherwise(short), F.lit(False))


def stopped_then(t: DataFrame) -> DataFrame:
    """Stopped trades whose price later went 1 or 2 units of risk their way within the holding limit (FOR3); later_r is the furthest it went."""
    stopped = F.col("result") == "STOP_LOSS"
    return t.withColumns({"stopped_then_1r": stopped & (F.col("later_r") >= 1), "stopped_then_2r": stopped & (F.col("later_r") >= 2)})


#: What a trade's context says about a loss (FOR4). Names and thresholds are fixed values; unknown context raises no tag.
FAILURES = {
    "EARLY_REVERSAL": lambda spread: (F.col("holding_minutes") <= 3) & (F.col("mfe_r") < 0.25),
    "SL_THEN_TP_REVERSAL": lambda spread: F.col("stopped_then_1r"),
    "RESISTANCE_FAILURE": lambda spread: (F.col("direction") == "LONG") & (F.col("to_resistance") <= 0.5),
    "SUPPORT_FAILURE": lambda spread: (F.col("direction") == "SHORT") & (F.col("to_support") <= 0.5),
    "TREND_MISMATCH": lambda spread: _for(F.col("trend") == "BEARISH", F.col("trend") == "BULLISH"),
    "RANGE_NOISE": lambda spread: (F.col("trend") == "RANGE") | F.coalesce(F.col("regime") == "RANGE", F.lit(False)),
    "MOMENTUM_EXHAUSTION": lambda spread: _for(F.col("rsi") >= 70, F.col("rsi") <= 30) | F.coalesce(F.col("to_ema50") >= 2, F.lit(False)),
    "HIGH_SPREAD_EROSION": lambda spread: (F.col("mfe") >= 1.5 * spread) & (F.col("r_h") < 0),
}

#: Conditions whose presence is contrasted with their absence (FOR7). Thresholds are fixed values.
CONDITIONS = {
    "trend_alignment": lambda: _for(F.col("trend") == "BULLISH", F.col("trend") == "BEARISH"),
    "rsi_zone": lambda: _for(F.col("rsi").between(45, 65), F.col("rsi").between(35, 55)),
    "macd_side": lambda: _for(F.col("macd_hist") > 0, F.col("macd_hist") < 0),
    "level_clearance": lambda: _for(F.col("to_resistance") >= 1, F.col("to_support") >= 1),
    "low_extension": lambda: F.coalesce(F.col("to_ema50") <= 1.5, F.lit(False)),
    "active_session": lambda: F.coalesce(F.col("session").isin("London", "New York", "London/NY Overlap"), F.lit(False)),
}


def failure_tags(t: DataFrame, spread: float = 0.3) -> DataFrame:
    """The losing trades with all FAILURES that fit, UNKNOWN if none (FOR4). A stop at 0 R, as at breakeven, is a loss.

    Of a trade: direction, result, r_h, holding_minutes, mfe and mfe_r (favourable
    excursion), later_r, and regime if it has one; of its signal: trend and rsi, and in ATR to_resistance,
    to_support and to_ema50.
    """
    t = stopped_then(t)
    t = t if "regime" in t.columns else t.withColumn("regime", F.lit(None).cast("string"))
    tags = F.array_compact(F.array(*[F.when(c(spread), n) for n, c in FAILURES.items()]))
    lost = loss() | ((F.col("r_h") == 0) & (F.col("result") == "STOP_LOSS"))
    return t.where(lost).withColumn("tags", F.when(F.size(tags) == 0, F.array(F.lit("UNKNOWN"))).otherwise(tags))


def category_counts(tagged: DataFrame) -> DataFrame:
    """How often each tag stands, its share of losses, and the mean return (FOR5)."""
    n = tagged.agg(F.count(F.lit(1)).alias("all"))
    g = tagged.select(F.explode("tags").alias("tag"), "r_h").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), _mean_h(F.col("r_h")).alias("average_r"))
    return g.join(F.broadcast(n)).select("tag", "n", F.round(F.col("n") * 100 / F.col("all"), 6).alias("share"), "average_r")  # n: one row


def score_direction(t: DataFrame) -> DataFrame:
    """Figures by score and by score and direction, ALL for both (FOR6)."""
    g = t.groupingSets([["strength"], ["strength", "direction"]], "strength", "direction")
    return g.agg(F.count(F.lit(1)).alias("trades"), _rate(win()).alias("win_rate"), _mean_h(F.col("r_h")).alias("average_r")).withColumn("direction", F.coalesce("direction", F.lit("ALL")))


def contrast(t: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Each condition's figures where it holds and where it does not, in one pass (FOR7)."""
    parts = []
    for name, c in conditions.items():
        n, m = F.count_if(c), F.count_if(~c)
        rate = lambda hit, k: F.round(F.count_if(hit & win()) * 100 / F.nullif(k, F.lit(0)), 6)
        lost = F.round(F.count_if(c & loss()) * 100 / F.nullif(n, F.lit(0)), 6)
        with_, without = F.round(F.avg(F.when(c, F.col("r_h"))) / 100, 6), F.round(F.avg(F.when(~c, F.col("r_h"))) / 100, 6)
        parts.append(F.struct(F.lit(name).alias("condition"), n.alias("present"), m.alias("absent"), rate(c, n).alias("present_win_rate"), rate(~c, m).alias("absent_win_rate"), lost.alias("present_loss_rate"), with_.alias("present_r"), without.alias("absent_r"), F.round(rate(c, n) - rate(~c, m), 6).alias("delta_win_rate"), F.round(with_ - without, 6).alias("delta_r")))
    return t.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def snapshot(trades: DataFrame, features: DataFrame) -> DataFrame:
    """Replayed trades with what was known at their signals (FOR2): trend, rsi, macd_hist, and in ATR to_resistance, to_support and to_ema50.

    features are those of signals.features(), a row a bar: an equi-join by symbol and signal time.
    """
    unit = F.greatest(F.lit(0.1), F.coalesce("atr", F.lit(1.5)))
    price = lambda c: F.try_element_at(c, F.lit(1))["price"]
    known = features.select("symbol", F.col("epoch_s").alias("signal_time"), F.col("trend").alias("_trend"), "structure", "rsi", F.col("macd.hist").alias("macd_hist"), ((price("resistances") - F.col("close")) / unit).alias("to_resistance"), ((F.col("close") - price("supports")) / unit).alias("to_support"), (F.abs(F.col("close") - F.col("ema50_5")) / unit).alias("to_ema50"))
    return trades.join(known, ["symbol", "signal_time"]).withColumn("trend", F.col("_trend")).drop("_trend")


def later_moves(trades: DataFrame, bars: DataFrame, limit_s: int) -> DataFrame:
    """Trades with later_r, the furthest favourable move from the entry after the exit and within a limit from the entry (FOR3).

    trades: symbol, trade_id, direction, entry_time, exit_time, entry_price, stop_dist.
    """
    spans = trades.select("symbol", "config_id", "trade_id", "direction", "entry_price", "stop_dist", (F.col("exit_time") + 1).alias("_from"), (F.col("entry_time") + limit_s).alias("_to"))
    j = interval(bars.select("symbol", "epoch_s", "high", "low"), spans, ["symbol"], "epoch_s", "_from", "_to", max(limit_s, 1))
    move = F.when(F.col("direction") == "LONG", F.col("high") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("low"))
    later = j.groupBy("symbol", "config_id", "trade_id").agg(F.round(F.max(move / F.col("stop_dist")), 6).alias("later_r"))
    return trades.join(later, ["symbol", "config_id", "trade_id"], "left").withColumn("later_r", F.greatest(F.lit(0.0), F.coalesce("later_r", F.lit(0.0))))


def holding_bucket(minutes: str) -> Column:
    """Holding times up to an hour in four buckets, the last with its end; null beyond (FOR9)."""
    m = F.col(minutes)
    return F.when(m < 5, "0-5").when(m < 15, "5-15").when(m < 30, "15-30").when(m <= 60, "30-60")


def losses_by(t: DataFrame, group: str) -> DataFrame:
    """Losses of each group and their share of all losses (FOR10)."""
    g = t.groupBy(group).agg(F.count_if(loss()).alias("losses"))
    return g.withColumn("share", F.round(F.col("losses") * 100 / F.sum("losses").over(Window.partitionBy()), 6))  # one row a group


def dimensions(t: DataFrame, columns: list[str], least: int = 100) -> DataFrame:
    """Figures over every combination of columns that has at least least trades (FOR15)."""
    return t.cube(*columns).agg(F.count(F.lit(1)).alias("trades"), _rate(win()).alias("win_rate"), _mean_h(F.col("r_h")).alias("average_r")).where(F.col("trades") >= least)


def overlapping(t: DataFrame, by: str) -> DataFrame:
    """Trades that begin before the one before them ended (AUD2)."""
    rows, keys = halo(t, [by], ["entry_time", "seq"], 0, 1)
    w = Window.partitionBy(*keys).orderBy("entry_time", "seq")
    return own(rows.withColumn("_next", F.lead("entry_time").over(w))).groupBy(by).agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.col("_next") < F.col("exit_time")).alias("overlaps"))


def same_bar(t: DataFrame, bars: DataFrame, by: list[str]) -> DataFrame:
    """Trades that end on the bar of their entry, and what it costs if each doubtful one was stopped (AUD1).

    t: symbol, entry_time, exit_time, direction, entry_price, stop_loss, target,
    result, r_h. A trade is doubtful if its entry bar touches the stop and the
    target, whose order the bar does not tell. An equi-join by symbol and time,
    one bar a trade; trades without their bar are counted and not doubtful.
    """
    b = bars.select("symbol", F.col("epoch_s").alias("entry_time"), "high", "low")
    long_ = F.col("direction") == "LONG"
    stopped = F.when(long_, F.col("low") <= F.col("stop_loss")).otherwise(F.col("high") >= F.col("stop_loss"))
    reached = F.when(long_, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    same = F.col("entry_time") == F.col("exit_time")
    x = t.join(b, ["symbol", "entry_time"], "left").withColumns({"_same": same, "_doubt": F.coalesce(same & stopped & reached, F.lit(False))})
    loss_h = F.when(F.col("_doubt"), F.least(F.col("r_h"), F.lit(-100))).otherwise(F.col("r_h"))
    out = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if("_same").alias("same_bar"),
        F.count_if(F.col("_same") & (F.col("result") == "STOP_LOSS")).alias("same_bar_stops"),
        F.count_if(F.col("_same") & (F.col("result") == "TP1")).alias("same_bar_targets"),
        F.count_if("_doubt").alias("doubtful"),
        (F.sum("r_h") / 100).alias("total_r"),
        (F.sum(loss_h) / 100).alias("careful_total_r"),
        ((F.sum(loss_h) - F.sum("r_h")) / 100).alias("delta_r"),
    )
    return out.withColumn("same_bar_share", F.round(F.col("same_bar") * 100 / F.col("trades"), 6))


def outcome_group() -> Column:
    """How a trade went, by its return and its greatest moves over the next sixty bars in units of risk (FOR13). Names and thresholds are fixed values."""
    won, lost = F.col("r_h") > 0, F.col("r_h") < 0
    return (
        F.when(won & (F.col("mae_r") <= 0.5), "GROUP_A_CLEAN_WIN")
        .when(lost & (F.col("holding_minutes") <= 3) & (F.col("mfe_r") >= 1), "GROUP_B_EARLY_REV")
        .when(lost & (F.col("mfe_r") < 1), "GROUP_C_FAILURE")
        .when(won, "OTHER_WIN")
        .otherwise("OTHER_LOSS")
    )


def reconcile(base: DataFrame, other: DataFrame, key: str = "trade_id") -> DataFrame:
    """Trades of two runs side by side (EXP5): removed, added, changed (by more than 0.01) or unchanged, and the difference."""
    a, b = base.select(F.col(key), F.col("r_h").alias("a")), other.select(F.col(key), F.col("r_h").alias("b"))
    change = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.abs(F.col("a") - F.col("b")) > 1, "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"), (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("d_h"))


def excursions(trades: DataFrame, bars: DataFrame, width: int) -> DataFrame:
    """Greatest favourable and adverse move of each trade over the bars from entry to exit, both included (FOR1, FOR3).

    trades: symbol, trade_id, direction, entry_time, exit_time, entry_price, risk.
    An interval join by time slots, then one aggregation by trade.
    """
    j = interval(bars.select("symbol", "epoch_s", "high", "low"), trades, ["symbol"], "epoch_s", "entry_time", "exit_time", width)
    long_ = F.col("direction") == "LONG"
    fav = F.greatest(F.lit(0.0), F.when(long_, F.col("high") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("low")))
    adv = F.greatest(F.lit(0.0), F.when(long_, F.col("entry_price") - F.col("low")).otherwise(F.col("high") - F.col("entry_price")))
    out = j.groupBy("symbol", "trade_id").agg(F.count(F.lit(1)).alias("bars"), F.round(F.max(fav), 6).alias("mfe"), F.round(F.max(adv), 6).alias("mae"), F.first("risk").alias("_risk"), F.min(F.when(adv >= F.col("risk"), F.col("epoch_s"))).alias("stop_s"), F.max_by("epoch_s", F.struct(fav, -F.col("epoch_s"))).alias("peak_s"))
    return out.withColumns({"mfe_r": F.round(F.col("mfe") / F.col("_risk"), 6), "mae_r": F.round(F.col("mae") / F.col("_risk"), 6)}).drop("_risk")


def forward(bars: DataFrame, direction: Column, horizons: tuple[int, ...]) -> DataFrame:
    """For each bar the greatest favourable and adverse move from its close over the next bars of some horizons (FOR13, FOR14, FOR16)."""
    rows, keys = halo(bars, ["symbol"], ["epoch_s"], 0, max(horizons))
    w = Window.partitionBy(*keys).orderBy("epoch_s")
    out = rows.withColumn("_d", direction)
    long_ = F.col("_d") == "LONG"
    new = {}
    for n in horizons:
        ahead = w.rowsBetween(1, n)
        hi, lo = F.max("high").over(ahead), F.min("low").over(ahead)
        some = hi.isNotNull()
        new[f"mfe{n}"] = F.when(some, F.round(F.greatest(F.lit(0.0), F.when(long_, hi - F.col("close")).otherwise(F.col("close") - lo)), 6))
        new[f"mae{n}"] = F.when(some, F.round(F.greatest(F.lit(0.0), F.when(long_, F.col("close") - lo).otherwise(hi - F.col("close"))), 6))
    return own(out.withColumns(new).drop("_d"))


def path_label(mae1: Column, mfe5: Column, mae5: Column) -> Column:
    """What the first five bars after a signal did, in units of risk, the first that fits (FOR16). For studies afterwards only."""
    instant = F.when(mfe5 >= 1, "EARLY_ADVERSE_THEN_RECOVERY").otherwise("PURE_ADVERSE")
    return F.when(mae1 >= 1, instant).when((mfe5 >= 1) & (mae5 <= 0.3), "FAST_CONTINUATION").when((mae5 <= 0.4) & (mfe5 >= 0.8), "IMMEDIATE_FAVORABLE").when(mae5.between(0.2, 0.6) & (mfe5 >= 0.6), "CONTROLLED_RETRACE").otherwise("CHOP")
