"""Statistics of trade ledgers (ST). Sums are of whole hundredths, so they do not depend on order.

Every function takes by, the columns that tell ledgers apart (none: one ledger).
What depends on the order of trades goes by day, entry_time and seq, and is
computed by two-level scans over days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.joins import profit_factor
from tidemark.plans.scan import running_max, running_sums, runs

ORDER = ["entry_time", "seq"]
CAPITAL = 10_000


def win() -> Column:
    return F.col("r_h") > 0


def loss() -> Column:
    return F.col("r_h") < 0


def _mean_h(c: Column) -> Column:
    """Mean of hundredths as a decimal value, 0 if there are none."""
    return F.round(F.coalesce(F.avg(c), F.lit(0.0)) / 100, 6)


def _rate(hit: Column) -> Column:
    return F.round(F.count_if(hit) * 100 / F.count(F.lit(1)), 6)


def headline(t: DataFrame, by: list[str], no_loss: float | None = 999.0) -> DataFrame:
    """Counts, win rate, returns, profit factor, extremes, holding times (ST1)."""
    n = F.count(F.lit(1))
    out = t.groupBy(*by).agg(
        n.alias("trades"),
        F.count_if(F.col("direction") == "LONG").alias("long_trades"),
        F.count_if(win()).alias("wins"),
        F.count_if(loss()).alias("losses"),
        F.count_if(F.col("result") == "EXPIRED").alias("expired"),
        _rate(win()).alias("win_rate"),
        (F.sum("r_h") / 100).alias("total_r"),
        _mean_h(F.col("r_h")).alias("average_r"),
        (F.median("r_h") / 100).alias("median_r"),
        F.coalesce(F.sum(F.when(win(), F.col("pnl"))), F.lit(0)).alias("_profit"),
        F.coalesce(-F.sum(F.when(loss(), F.col("pnl"))), F.lit(0)).alias("_loss"),
        _mean_h(F.when(win(), F.col("r_h"))).alias("average_win_r"),
        _mean_h(F.when(loss(), F.col("r_h"))).alias("average_loss_r"),
        (F.max("r_h") / 100).alias("largest_win_r"),
        (F.min("r_h") / 100).alias("largest_loss_r"),
        F.round(F.avg("holding_minutes"), 6).alias("average_holding"),
        F.max("holding_minutes").alias("max_holding"),
    )
    return out.withColumn("profit_factor", profit_factor(F.col("_profit"), F.col("_loss"), no_loss)).drop("_profit", "_loss")


def equity_curve(t: DataFrame, by: list[str], value: str = "pnl", capital: int = CAPITAL) -> DataFrame:
    """The trades with equity after each, its peak (at least the capital), drawdown and its percentage of the peak (ST2)."""
    e = running_sums(t, by, "day", ORDER, {"equity": F.col(value)}).withColumn("equity", F.col("equity") + capital)
    e = running_max(e, by, "day", ORDER, "equity", "peak", F.lit(capital))
    dd = F.col("peak") - F.col("equity")
    return e.withColumns({"drawdown": dd, "drawdown_pct": F.when(F.col("peak") > 0, F.round(dd * 100 / F.col("peak"), 6)).otherwise(F.when(dd > 0, 100.0).otherwise(0.0))})


def drawdown(t: DataFrame, by: list[str], value: str = "pnl", capital: int = CAPITAL) -> DataFrame:
    """Greatest drawdown and greatest percentage."""
    return equity_curve(t, by, value, capital).groupBy(*by).agg(F.max("drawdown").alias("max_drawdown"), F.max("drawdown_pct").alias("max_drawdown_pct"))


def _combined(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """One row a ledger from several frames of one row a ledger; the first has all ledgers."""
    out = parts[0]
    for p in parts[1:]:
        if by:
            p = p.withColumnsRenamed({c: f"_r_{c}" for c in by})
            on = None
            for c in by:
                k = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
                on = k if on is None else on & k
            out = out.join(p, on, "left").drop(*[f"_r_{c}" for c in by])
        else:
            out = out.join(p, how="left")  # one row each
    return out


def _longest(t: DataFrame, by: list[str], inside: Column, name: str) -> DataFrame:
    return runs(t, by, "day", ORDER, inside, name).groupBy(*by).agg(F.max(name).alias(name))


def streaks(t: DataFrame, by: list[str]) -> DataFrame:
    """Longest runs of wins and of losses; a trade of 0 ends both (ST3)."""
    n = t.groupBy(*by).agg(F.count(F.lit(1)).alias("trades"))
    return _combined([n, _longest(t, by, win(), "max_wins"), _longest(t, by, loss(), "max_losses")], by).fillna(0, ["max_wins", "max_losses"])


def by_group(t: DataFrame, group: Column, name: str) -> DataFrame:
    """Trades, wins, win rate, total and mean return and profit factor of each group (ST4, ST6, ST7)."""
    out = t.groupBy(group.alias(name)).agg(F.count(F.lit(1)).alias("trades"), F.count_if(win()).alias("wins"), _rate(win()).alias("win_rate"), (F.sum("r_h") / 100).alias("total_r"), _mean_h(F.col("r_h")).alias("average_r"), F.coalesce(F.sum(F.when(win(), F.col("pnl"))), F.lit(0)).alias("p"), F.coalesce(-F.sum(F.when(loss(), F.col("pnl"))), F.lit(0)).alias("l"))
    return out.withColumn("profit_factor", profit_factor(F.col("p"), F.col("l"), 999.0)).drop("p", "l")


def by_direction(t: DataFrame) -> DataFrame:
    """Each direction's figures with a drawdown of its own equity (ST5)."""
    return _combined([by_group(t, F.col("direction"), "direction"), drawdown(t, ["direction"])], ["direction"])


def slice_summary(t: DataFrame, by: list[str], capital: int = CAPITAL) -> DataFrame:
    """Headline, drawdown, streaks and depletion: the 0-based index of the first trade with no equity left (ST8)."""
    e = running_sums(equity_curve(t, by, capital=capital), by, "day", ORDER, {"_n": F.lit(1)})
    d = e.groupBy(*by).agg(F.max("drawdown").alias("max_drawdown"), F.max("drawdown_pct").alias("max_drawdown_pct"), F.min(F.when(F.col("equity") <= 0, F.col("_n") - 1)).alias("depletion_index"))
    side = t.groupBy(*by).agg(*[x for s in ("LONG", "SHORT") for x in (F.coalesce(F.round(F.count_if(win() & (F.col("direction") == s)) * 100 / F.nullif(F.count_if(F.col("direction") == s), F.lit(0)), 6), F.lit(0.0)).alias(f"{s.lower()}_win_rate"), (F.coalesce(F.sum(F.when(F.col("direction") == s, F.col("r_h"))), F.lit(0)) / 100).alias(f"{s.lower()}_total_r"))])
    return _combined([headline(t, by, None), d, streaks(t, by).drop("trades"), side], by).withColumn("solvent", F.col("depletion_index").isNull())


def expectancy(t: DataFrame, by: list[str]) -> DataFrame:
    """p(win) x mean win - p(loss) x mean loss, from factors rounded first, and reward to risk (ST9)."""
    f = t.groupBy(*by).agg(
        F.round(F.count_if(win()) / F.count(F.lit(1)), 4).alias("win_probability"),
        F.round(F.count_if(loss()) / F.count(F.lit(1)), 4).alias("loss_probability"),
        F.round(F.coalesce(F.avg(F.when(win(), F.col("r_h"))), F.lit(0.0)) / 100, 2).alias("average_win_r"),
        F.round(F.coalesce(-F.avg(F.when(loss(), F.col("r_h"))), F.lit(0.0)) / 100, 2).alias("average_loss_r"),
    )
    return f.withColumns({"reward_risk": F.coalesce(F.round(F.col("average_win_r") / F.nullif(F.col("average_loss_r"), F.lit(0.0)), 4), F.lit(0.0)), "expectancy": F.round(F.col("win_probability") * F.col("average_win_r") - F.col("loss_probability") * F.col("average_loss_r"), 5)})


def drawdown_analysis(t: DataFrame, by: list[str], capital: int = CAPITAL) -> DataFrame:
    """Trades under water, the longest time there, losing streaks and recovery (ST10); equity at the peak is not under water."""
    e = equity_curve(t, by, capital=capital)
    under = F.col("drawdown") > 0
    d = e.groupBy(*by).agg(F.max("drawdown").alias("max_drawdown"), F.max("drawdown_pct").alias("max_drawdown_pct"), F.round(F.coalesce(F.avg(F.when(under, F.col("drawdown"))), F.lit(0.0)), 6).alias("average_drawdown"), F.count_if(under).alias("trades_under_water"), F.sum("pnl").alias("_gain"))
    longest = _longest(e, by, under, "longest_under_water")
    losing = runs(t, by, "day", ORDER, loss(), "n").groupBy(*by).agg(F.max("n").alias("max_losing_streak"), F.round(F.avg("n"), 6).alias("average_losing_streak"))
    out = _combined([d, longest, losing], by).fillna(0, ["longest_under_water", "max_losing_streak", "average_losing_streak"])
    return out.withColumn("recovery_factor", F.when(F.col("max_drawdown") > 0, F.round(F.col("_gain") / F.col("max_drawdown"), 6)).when(F.col("_gain") > 0, 999.0).otherwise(0.0)).drop("_gain")


def month(epoch_s: str) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_s), "yyyy-MM")


def monthly(t: DataFrame, capital: int = CAPITAL) -> DataFrame:
    """Each month of entry with its own drawdown (ST11)."""
    m = t.withColumn("month", month("entry_time"))
    return _combined([by_group(m, F.col("month"), "month"), drawdown(m, ["month"], capital=capital)], ["month"])


def concentration(t: DataFrame) -> DataFrame:
    """Share of the total return in the best one, two and three months, and the total without them (ST12)."""
    m = t.groupBy(month("entry_time").alias("month")).agg(F.sum("r_h").alias("h"))
    w = Window.orderBy(F.desc("h"), "month")  # one row a month
    r = m.withColumn("n", F.row_number().over(w))
    total = F.sum("h")
    top = lambda k: F.coalesce(F.sum(F.when(F.col("n") <= k, F.col("h"))), F.lit(0))
    return r.agg((total / 100).alias("total_r"), *[x for k in (1, 2, 3) for x in (F.when(total > 0, F.round(top(k) * 100 / total, 6)).otherwise(0.0).alias(f"top{k}_pct"), ((total - top(k)) / 100).alias(f"total_without_top{k}"))])


def consistency(windows: DataFrame) -> DataFrame:
    """Over windows (label, total_r, profit_factor): shares of good ones, medians, spread, best and worst, the first on ties (ST13)."""
    n = F.count(F.lit(1))
    return windows.agg(
        n.alias("windows"),
        F.round(F.count_if(F.col("total_r") > 0) / n, 6).alias("positive_share"),
        F.round(F.count_if(F.col("profit_factor") > 1) / n, 6).alias("factor_over_one_share"),
        F.round(F.median("total_r"), 6).alias("median_r"),
        F.round(F.coalesce(F.when(n > 1, F.stddev_samp("total_r")), F.lit(0.0)), 6).alias("std_r"),
        F.max(F.struct("total_r", F.expr("-window_index AS k"), "label"))["label"].alias("best"),
        F.min(F.struct("total_r", "window_index", "label"))["label"].alias("worst"),
    )


def out_of_sample(windows: DataFrame) -> DataFrame:
    """Sums and extremes over windows; one of 0 counts as negative (ST14)."""
    return windows.agg(F.count(F.lit(1)).alias("windows"), F.sum("trades").alias("trades"), F.sum("wins").alias("wins"), F.round(F.sum("total_r"), 6).alias("total_r"), F.count_if(F.col("total_r") > 0).alias("positive"), F.count_if(F.col("total_r") <= 0).alias("negative"), F.max("max_drawdown").alias("max_drawdown"))


def distribution(t: DataFrame, by: list[str], value: str, points: tuple[float, ...] = (0.1, 0.25, 0.75, 0.9, 0.95)) -> DataFrame:
    """Mean, median, sample deviation and percentiles by the index floor(p (n - 1)) (ST15).

    Values are counted first, so a group's rows are its distinct values.
    """
    v = t.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("to", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    at = lambda i: F.min(F.when(F.col("to") > i, F.col("v")))
    n = F.first("n")
    mean = F.sum(F.col("v") * F.col("c")) / F.sum("c")
    floor = lambda p: F.floor(F.lit(p) * (F.col("n") - 1))
    return v.groupBy(*by).agg(
        n.alias("n"),
        F.round(mean, 6).alias("mean"),
        F.round((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2, 6).alias("median"),
        *[at(floor(p)).alias(f"p{round(p * 100)}") for p in points],
    )


def percentiles(t: DataFrame, by: list[str], value: str, points: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Percentiles by linear interpolation on (n - 1) p (ST16)."""
    return t.groupBy(*by).agg(*[F.round(F.percentile(value, p), 6).alias(f"p{round(p * 100)}") for p in points])


def bucket_metrics(t: DataFrame, group: Column, name: str) -> DataFrame:
    """Counts, shares of all, profit factor on returns (0 without losses), early stops within three minutes (ST17)."""
    quick = (F.col("result") == "STOP_LOSS") & (F.col("holding_minutes") <= 3)
    g = t.groupBy(group.alias(name)).agg(F.count(F.lit(1)).alias("trades"), _rate(win()).alias("win_rate"), (F.sum("r_h") / 100).alias("total_r"), _mean_h(F.col("r_h")).alias("average_r"), F.coalesce(F.sum(F.when(win(), F.col("r_h"))), F.lit(0)).alias("p"), F.coalesce(-F.sum(F.when(loss(), F.col("r_h"))), F.lit(0)).alias("l"), _rate(quick).alias("early_stop_rate"))
    share = F.round(F.col("trades") * 100 / F.sum("trades").over(Window.partitionBy()), 6)  # one row a group
    return g.withColumns({"share": share, "profit_factor": profit_factor(F.col("p"), F.col("l"), 0.0)}).drop("p", "l")


def slice_metrics(t: DataFrame, by: list[str]) -> DataFrame:
    """Returns and their drawdown from 0 (ST18)."""
    e = running_sums(t, by, "day", ORDER, {"equity": F.col("r_h")})
    e = running_max(e, by, "day", ORDER, "equity", "peak", F.lit(0))
    d = e.groupBy(*by).agg((F.max(F.col("peak") - F.col("equity")) / 100).alias("max_drawdown_r"))
    return _combined([headline(t, by, 0.0).select(*by, "trades", "win_rate", "total_r", "average_r", "profit_factor"), d, streaks(t, by).drop("trades")], by)


def delta(base: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """other less base for rows of headline figures (ST19); expectancy counts trades of 0 as losses."""
    figures = lambda d, k: d.select(*on, F.col("trades").alias(f"{k}_trades"), F.col("total_r").alias(f"{k}_r"), F.col("win_rate").alias(f"{k}_win"), (F.col("win_rate") / 100 * F.col("average_win_r") - (1 - F.col("win_rate") / 100) * F.abs("average_loss_r")).alias(f"{k}_e"))
    j = figures(base, "a").join(figures(other, "b"), on)
    return j.select(*on, (F.col("b_trades") - F.col("a_trades")).alias("d_trades"), F.round(F.col("b_r") - F.col("a_r"), 6).alias("d_total_r"), F.round(F.col("b_win") - F.col("a_win"), 6).alias("d_win_rate"), F.round(F.col("b_e") - F.col("a_e"), 6).alias("d_expectancy"), F.when(F.col("b_trades") < F.col("a_trades"), F.round((F.col("a_trades") - F.col("b_trades")) * 100 / F.col("a_trades"), 6)).otherwise(0.0).alias("reduction_pct"))


def journal_metrics(journal: DataFrame, by: list[str]) -> DataFrame:
    """Events of each state and the closed trades' figures; profit factor 1 for wins alone (ST20)."""
    done = F.col("r_h").isNotNull()
    g = journal.groupBy(*by).agg(*[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("FILLED", "TIMED_OUT", "INVALIDATED", "BLOCKED", "CLOSED")], F.count_if(done).alias("trades"), F.coalesce(F.sum("r_h"), F.lit(0)).alias("h"), F.coalesce(F.sum(F.when(win(), F.col("r_h"))), F.lit(0)).alias("p"), F.coalesce(-F.sum(F.when(loss(), F.col("r_h"))), F.lit(0)).alias("l"))
    return g.withColumns({"total_r": F.col("h") / 100, "profit_factor": profit_factor(F.col("p"), F.col("l"), 1.0)}).drop("h", "p", "l")


def correlations(t: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's correlation of each pair of columns, in one pass (ST21): a, b, r."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = t.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}|{b}`"), 6).alias("r")) for a, b in pairs])).alias("x")).select("x.*")
