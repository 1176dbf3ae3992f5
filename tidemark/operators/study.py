"""One study, one plan: sweeps, walk-forward windows and stages over one table of trades (VAL9, EXP7, the facts of VAL8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import experiments, replay, stats
from tidemark.operators.replay import Config
from tidemark.plans.joins import profit_factor
from tidemark.session import written

#: (index, train start and end, validation start and end), as windows.slices() gives them.
Slices = list[tuple[int, int, int, int, int]]


def sweeps(base: Config, spreads: list[float], thresholds: list[int]) -> list[Config]:
    """The baseline, spreads, thresholds and exit profiles: all that a study replays."""
    return [base, *experiments.sweep(base, "spread", spreads), *experiments.sweep(base, "threshold", thresholds), *experiments.exit_profiles(base)]


def window_of(time: Column, slices: Slices) -> Column:
    """Index of the validation window of a time, null if none. Windows are made from a calendar and must not overlap."""
    if any(a[4] > b[3] for a, b in zip(slices, slices[1:], strict=False)):
        raise ValueError("validation windows overlap")
    if not slices:
        return F.lit(None).cast("int")
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, _, _, lo, hi in slices])
    return F.try_element_at(F.filter(rows, lambda w: (time >= w["lo"]) & (time < w["hi"])), F.lit(1))["i"]


def stage_of(time: Column, slices: Slices) -> Column:
    """development before the last window, final from its start on; all is development where there is no window."""
    return F.when(time < slices[-1][3], "development").otherwise("final") if slices else F.lit("development")


def staged(trades: DataFrame, slices: Slices) -> DataFrame:
    """trades with the window and the stage of their entry."""
    return trades.withColumns({"window_index": window_of(F.col("entry_time"), slices), "stage": stage_of(F.col("entry_time"), slices)})


def figures(rows: DataFrame, key: str = "config_id") -> DataFrame:
    """Figures of every configuration over all its trades, by window and by stage: grouping sets of one aggregation.

    rows: staged() trades with the key and r_h. scope tells which set a row is of.
    """
    r = F.col("r_h")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    g = rows.groupingSets([[key], [key, "window_index"], [key, "stage"]], key, "window_index", "stage").agg(
        F.when(F.grouping("window_index") == 0, "window").when(F.grouping("stage") == 0, "stage").otherwise("all").alias("scope"),
        F.count(F.lit(1)).alias("trades"), F.count_if(r > 0).alias("wins"), (total(r) / 100).alias("total_r"), F.round(F.avg(r) / 100, 6).alias("average_r"),
        profit_factor(total(F.when(r > 0, r)), total(F.when(r < 0, -r)), 999.0).alias("profit_factor"),
    )
    return g.where("scope <> 'window' OR window_index IS NOT NULL")


def replayed(signals: DataFrame, bars: DataFrame, configs: list[Config], slices: Slices, bar_seconds: int, max_minutes: int) -> DataFrame:
    """The trades of all configurations with window and stage, written once: signals and features are computed a single time.

    Thresholds and exits are judged on the development stage, so figures() of
    these never need another replay.
    """
    t = replay.replay(signals, bars, replay.frame(signals.sparkSession, configs), bar_seconds, max_minutes=max_minutes)
    return written(staged(t.withColumns({"seq": F.col("signal_time"), "day": F.floor(F.col("entry_time") / 86400)}), slices), "study")


def facts(rows: DataFrame, base: str, slices: Slices) -> DataFrame:
    """What flags() judges, from the sweeps of a study (VAL8): one row.

    Spread facts are of the lowest and highest spread over all trades; threshold
    and exit facts of the development stage alone; the rest of the baseline.
    """
    b = rows.where(F.col("config_id") == base)
    out = experiments.facts(b.withColumn("book", F.lit(1)), ["book"]).drop("low_spread_average_r", "high_spread_average_r", "low_spread_total_r", "high_spread_total_r", "low_threshold_win_rate", "high_threshold_win_rate", "low_threshold_trades", "high_threshold_trades", "min_exit_total_r", "max_exit_total_r", "windows", "oos_trades", "oos_total_r", "oos_average_r")
    r, oos = F.col("r_h"), (F.col("config_id") == base) & F.col("window_index").isNotNull()
    value = lambda name: F.regexp_extract("config_id", f"^{name}=(.*)$", 1).try_cast("double")
    s, t, dev = value("spread"), value("threshold"), F.col("stage") == "development"
    ends = rows.agg(F.min(s).alias("s0"), F.max(s).alias("s1"), F.min(t).alias("t0"), F.max(t).alias("t1"))
    x = rows.withColumns({"_s": s, "_t": t}).join(F.broadcast(ends))  # ends: one row
    total = lambda c: F.coalesce(F.sum(F.when(c, r)), F.lit(0)) / 100
    rate = lambda c: F.coalesce(F.round(F.count_if(c & (r > 0)) * 100 / F.nullif(F.count_if(c), F.lit(0)), 6), F.lit(0.0))
    mean = lambda c: F.round(F.avg(F.when(c, r)) / 100, 6)
    low_s, high_s, low_t, high_t = F.col("_s") == F.col("s0"), F.col("_s") == F.col("s1"), dev & (F.col("_t") == F.col("t0")), dev & (F.col("_t") == F.col("t1"))
    exits = [total(dev & (F.col("config_id") == c)) for c in experiments.EXIT_PROFILES]
    more = x.agg(
        mean(low_s).alias("low_spread_average_r"), mean(high_s).alias("high_spread_average_r"), total(low_s).alias("low_spread_total_r"), total(high_s).alias("high_spread_total_r"),
        rate(low_t).alias("low_threshold_win_rate"), rate(high_t).alias("high_threshold_win_rate"), F.count_if(low_t).alias("low_threshold_trades"), F.count_if(high_t).alias("high_threshold_trades"),
        F.least(*exits).alias("min_exit_total_r"), F.greatest(*exits).alias("max_exit_total_r"),
        F.lit(len(slices)).alias("windows"), F.count_if(oos).alias("oos_trades"), total(oos).alias("oos_total_r"), mean(oos).alias("oos_average_r"),
    )
    return out.join(F.broadcast(more)).drop("book")  # one row by one row


def verdicts(rows: DataFrame, boundary: int) -> DataFrame:
    """The baseline's verdict over the development stage (OOS1); a study whose development reaches the final window is stopped (EXP7)."""
    last = rows.where("stage = 'development'").agg(F.min("entry_time"), F.max("entry_time")).first()
    if last[0] is not None:
        experiments.guard(last[0], last[1], boundary)
    return experiments.verdict(stats.headline(rows.where("stage = 'development'"), ["config_id"]), ["config_id"])
