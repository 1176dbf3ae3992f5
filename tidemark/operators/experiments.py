"""Experiments: signal filters, ablations, comparisons and verdicts (EXP, VAL8, VAL10, OOS1)."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import replay, signals, stats
from tidemark.operators.replay import Config


@dataclass(frozen=True)
class Experiment:
    """One change against the baseline: values of the configuration, a filter of signals, or scoring rules left out."""

    id: str
    title: str
    changes: dict = field(default_factory=dict)
    filter: str | None = None
    value: float | None = None
    without: tuple[str, ...] = ()


#: Exits that several experiments share: a wider stop, and the first target as far as the second.
_WIDER = {"stop_atr": 1.5, "target1_atr": 2.0, "target2_atr": 2.0}

#: The registry (EXP1): ablations of scoring rules, filters of signals, changes of exits. Ids and values are fixed values.
EXPERIMENTS = (
    Experiment("ABL-001", "without the RSI rules", without=("strength_zone", "strength_extreme")),
    Experiment("ABL-002", "without the MACD rule", without=("momentum",)),
    Experiment("EXP-001", "spread of at most 0.40", filter="spread_threshold", value=0.40),
    Experiment("EXP-002", "trend must agree", filter="strict_trend"),
    Experiment("EXP-003", "no signals in ranges", filter="no_range"),
    Experiment("EXP-004", "at least 0.4 ATR clear of an opposing level", filter="level_clearance", value=0.4),
    Experiment("EXP-005", "wider stop and target", _WIDER),
    Experiment("EXP-006", "score of at least 8", {"threshold": 8}),
    Experiment("EXP-007", "wider, breakeven from 1 R", _WIDER | {"breakeven_r": 1.0}),
    Experiment("EXP-008", "wider, trailing 1 ATR from 1 R", _WIDER | {"trail_r": 1.0, "trail_atr": 1.0}),
    Experiment("EXP-009", "at most 2 ATR beyond the slow average", filter="overextension", value=2.0),
    Experiment("EXP-010", "more than 0.5 ATR from an opposing level", filter="level_proximity", value=0.5),
    Experiment("EXP-011", "wider, idle trades left after ten minutes below 0.25 R", _WIDER | {"idle_minutes": 10, "idle_r": 0.25}),
    Experiment("EXP-012", "not both overextended and near an opposing level", filter="exhaustion_guard", value=2.0),
)


def by_id(experiment_id: str) -> Experiment:
    for e in EXPERIMENTS:
        if e.id == experiment_id.upper():
            return e
    raise KeyError(f"no experiment {experiment_id}; there are {', '.join(e.id for e in EXPERIMENTS)}")


def keep(name: str, value: float | None) -> Column:
    """Which scored bars a filter keeps (EXP2)."""
    unit = F.coalesce("atr", F.lit(1.5))
    long_ = F.col("type") == "LONG_SETUP"
    nearest = F.when(long_, F.try_element_at("resistances", F.lit(1))["price"] - F.col("close")).otherwise(F.col("close") - F.try_element_at("supports", F.lit(1))["price"])
    beyond = F.when(long_, F.col("close") - F.col("ema50_5")).otherwise(F.col("ema50_5") - F.col("close"))
    filters = {
        "spread_threshold": lambda: replay.spread_dollars(F.col("spread")) <= value,
        "strict_trend": lambda: F.col("trend") == F.when(long_, "BULLISH").otherwise("BEARISH"),
        "no_range": lambda: F.col("trend") != "RANGE",
        "level_clearance": lambda: F.coalesce(nearest > unit * value, F.lit(True)),
        "level_proximity": lambda: F.coalesce(nearest > unit * value, F.lit(True)),
        "overextension": lambda: F.coalesce(beyond <= unit * value, F.lit(True)),
        "exhaustion_guard": lambda: ~F.coalesce((beyond > unit * value) & (nearest <= unit * 0.5), F.lit(False)),
    }
    if name not in filters:
        raise KeyError(f"no filter {name}; there are {', '.join(filters)}")
    return filters[name]()


def run_id(config: Config, *more: object) -> str:
    """Sixteen hex digits of a configuration and what else decides a result (VAL10)."""
    return hashlib.sha256(json.dumps([asdict(config), *map(str, more)], sort_keys=True).encode()).hexdigest()[:16]


def guard(start: int, end: int, boundary: int) -> None:
    """Stop before any work if a range reaches the final window (EXP7)."""
    if start >= boundary or end > boundary:
        raise ValueError(f"{start}..{end} reaches the final window from {boundary}")


#: Rules of flags() (VAL8): code, severity, condition, and the fact that shows it. Codes and thresholds are fixed values.
FLAG_RULES = (
    ("INSUFFICIENT_HISTORY", "CAUTION", "history_days < 180", "history_days"),
    ("LIMITED_HISTORY", "INFO", "history_days >= 180 AND history_days < 350", "history_days"),
    ("INCOMPLETE_DATASET", "WARNING", "NOT complete", "complete"),
    ("INSUFFICIENT_OOS_WINDOWS", "CAUTION", "windows < 1", "windows"),
    ("INSUFFICIENT_OOS_WINDOWS", "WARNING", "windows >= 1 AND windows < 6", "windows"),
    ("LOW_SAMPLE_SIZE", "WARNING", "trades < 30", "trades"),
    ("LOW_OOS_SAMPLE", "INFO", "windows >= 1 AND oos_trades < 30", "oos_trades"),
    ("NEGATIVE_OOS_EXPECTANCY", "WARNING", "windows >= 1 AND (oos_average_r < 0 OR oos_total_r < 0)", "oos_total_r"),
    ("HIGH_SPREAD_SENSITIVITY", "WARNING", "low_spread_average_r - high_spread_average_r >= 0.12 OR (low_spread_total_r > 0 AND high_spread_total_r < 0)", "high_spread_total_r"),
    ("HIGH_THRESHOLD_SENSITIVITY", "INFO", "abs(low_threshold_win_rate - high_threshold_win_rate) > 20 OR (high_threshold_trades < 10 AND low_threshold_trades >= 30)", "high_threshold_win_rate"),
    ("HIGH_EXIT_SENSITIVITY", "INFO", "max_exit_total_r - min_exit_total_r > 10", "max_exit_total_r"),
    ("HIGH_PERIOD_CONCENTRATION", "WARNING", "top1_pct > 50 AND total_r > 0", "top1_pct"),
    ("DIRECTIONAL_ASYMMETRY", "INFO", "long_trades > 5 AND short_trades > 5 AND (abs(long_win_rate - short_win_rate) > 15 OR long_total_r * short_total_r < 0)", "long_win_rate"),
    ("HIGH_DRAWDOWN", "CAUTION", "max_drawdown_pct >= 15", "max_drawdown_pct"),
)


def flags(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Coded warnings of one row of facts each, as FLAG_RULES say (VAL8): flag, severity, fact and its value; unknown facts raise none."""
    hit = F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(n).alias("flag"), F.lit(s).alias("severity"), F.lit(x).alias("fact"), F.round(F.col(x).cast("double"), 6).alias("value"))) for n, s, c, x in FLAG_RULES]))
    return facts.select(*keys, F.explode(hit).alias("x")).select(*keys, "x.*")


def facts(t: DataFrame, keys: list[str], first_days: int = 90, window_days: int = 30, spread_h: int = 10) -> DataFrame:
    """What flags() judges, from a ledger: the first days are for development, windows of equal length follow.

    Spreads, thresholds and exits are those the ledger itself can tell: returns
    less spread_h hundredths, signals of strength 10 alone, returns capped at 1
    and 1.5 R. A simulated sweep gives its own columns of these names.
    """
    r = F.col("r_h")
    t = t.join(t.groupBy(*keys).agg(F.min("entry_time").alias("_from")), keys)
    oos, up, side = F.col("entry_time") >= F.col("_from") + 86400 * first_days, r > 0, lambda s: F.col("direction") == s
    rate = lambda hit, n: F.coalesce(F.round(F.count_if(hit) * 100 / F.nullif(F.count_if(n), F.lit(0)), 6), F.lit(0.0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)) / 100
    span = F.floor((F.max("exit_time") - F.min("entry_time")) / 86400)
    exits = [total(F.least(r, F.lit(cap))) for cap in (100, 150)] + [total(r)]
    out = t.groupBy(*keys).agg(
        span.alias("history_days"),
        (F.count_distinct("day") >= span).alias("complete"),
        F.greatest(F.lit(0), F.floor((span - first_days) / window_days)).alias("windows"),
        F.count(F.lit(1)).alias("trades"),
        total(r).alias("total_r"),
        F.count_if(oos).alias("oos_trades"),
        total(F.when(oos, r)).alias("oos_total_r"),
        F.round(F.avg(F.when(oos, r)) / 100, 6).alias("oos_average_r"),
        F.round(F.avg(r) / 100, 6).alias("low_spread_average_r"),
        F.round(F.avg(r - spread_h) / 100, 6).alias("high_spread_average_r"),
        total(r).alias("low_spread_total_r"),
        total(r - spread_h).alias("high_spread_total_r"),
        rate(up, F.lit(True)).alias("low_threshold_win_rate"),
        rate(up & (F.col("strength") >= 10), F.col("strength") >= 10).alias("high_threshold_win_rate"),
        F.count(F.lit(1)).alias("low_threshold_trades"),
        F.count_if(F.col("strength") >= 10).alias("high_threshold_trades"),
        F.least(*exits).alias("min_exit_total_r"),
        F.greatest(*exits).alias("max_exit_total_r"),
        *[x for s in ("LONG", "SHORT") for x in (F.count_if(side(s)).alias(f"{s.lower()}_trades"), rate(side(s) & up, side(s)).alias(f"{s.lower()}_win_rate"), total(F.when(side(s), r)).alias(f"{s.lower()}_total_r"))],
    )
    month = F.date_format(F.timestamp_seconds("entry_time"), "yyyy-MM")
    months = t.groupBy(*keys, month.alias("_month")).agg(F.sum("r_h").alias("m")).groupBy(*keys).agg(F.coalesce(F.round(F.greatest(F.max("m"), F.lit(0)) * 100 / F.nullif(F.sum(F.greatest("m", F.lit(0))), F.lit(0)), 6), F.lit(0.0)).alias("top1_pct"))
    drawdown = stats.equity_curve(t.drop("_from"), keys).groupBy(*keys).agg(F.max("drawdown_pct").alias("max_drawdown_pct"))
    return out.join(months, keys).join(drawdown, keys)


def verdict(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """INCONCLUSIVE below 100 trades, PASS with positive mean and total and a factor of at least 1.05, else FAIL (OOS1)."""
    good = (F.col("average_r") > 0) & (F.col("profit_factor") >= 1.05) & (F.col("total_r") > 0)
    return metrics.select(*keys, "trades", "total_r", "profit_factor", F.when(F.col("trades") < 100, "INCONCLUSIVE").when(good, "PASS").otherwise("FAIL").alias("verdict"))


def compare(trades: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Each configuration's headline less the baseline's (ST19, EXP3).

    Headlines, one row a configuration, are made once and compared on the driver's copy.
    """
    h = stats.headline(trades, ["config_id"])
    h = trades.sparkSession.createDataFrame(h.collect(), h.schema)
    base = h.where(F.col("config_id") == baseline).drop("config_id").withColumn("k", F.lit(1))
    other = h.where(F.col("config_id") != baseline).withColumn("k", F.lit(1))
    d = stats.delta(base.crossJoin(F.broadcast(other.select("config_id"))), other.drop("k"), ["config_id"])  # one row by one a configuration
    return d


def sweep(base: Config, name: str, values: list) -> list[Config]:
    """Configurations that differ in one value (VAL4-6)."""
    return [Config(**(asdict(base) | {"config_id": f"{name}={v}", name: v})) for v in values]


#: Exit profiles of a sensitivity study (VAL6): stop, first and second target in ATR. Fixed values.
EXIT_PROFILES = {"Case A": (0.75, 1.0, 1.0), "Case B": (1.0, 1.0, 1.0), "Case C": (1.0, 1.5, 1.5), "Case D": (1.0, 2.0, 2.0), "Case E": (1.5, 2.0, 2.0)}


def exit_profiles(base: Config) -> list[Config]:
    return [Config(**(asdict(base) | {"config_id": k, "stop_atr": s, "target1_atr": a, "target2_atr": b})) for k, (s, a, b) in EXIT_PROFILES.items()]


def small_samples(headlines: DataFrame, least: int = 30) -> DataFrame:
    """Marks configurations of fewer trades than least (VAL5): their figures are to be read with caution."""
    return headlines.withColumn("small_sample", F.col("trades") < least)


def tagged_signals(features: DataFrame, threshold: int) -> DataFrame:
    """The signals of the baseline and of every experiment, with only: the configuration that they are for (EXP3).

    Filters and exits share one scoring, a row of which goes to all experiments
    that keep it; ablations score anew.
    """
    scored = signals.score(features, threshold)
    ids = [F.lit("baseline"), *(F.when(keep(e.filter, e.value), e.id) if e.filter else F.lit(e.id) for e in EXPERIMENTS if not e.without)]
    some = scored.where("type <> 'WAIT'").withColumn("only", F.explode(F.array_compact(F.array(*ids))))
    out = signals.signals(some, "only")
    for e in EXPERIMENTS:
        if e.without:
            out = out.unionByName(signals.signals(signals.score(features, threshold, frozenset(e.without)).withColumn("only", F.lit(e.id)), "only"))
    return out
