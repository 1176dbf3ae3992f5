"""Trade replay: exits of every signal in parallel, then the trades that one open position allows (REP, VAL4-6).

Whether a signal opens a trade depends on the trade before it. But what becomes
of a signal if it is taken depends only on the bars that follow within the
holding limit. So fills and exits of all signals and all configurations are one
fold each over a bounded array. The choice of trades is a chain of spans, which
is followed in time blocks.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import classify, entries
from tidemark.plans.chains import NEVER, chained


@dataclass(frozen=True)
class Config:
    """One simulation; what may be None is then off.

    slippage_atr worsens an entry by so many ATR beyond the spread (AUD4);
    from_signal measures max_minutes from the signal instead of the entry (AUD3);
    historical pays the spread of the bar of entry where it is known (REP3).
    """

    config_id: str = "baseline"
    threshold: int = 7
    spread: float = 0.3
    stop_atr: float = 1.0
    target1_atr: float = 1.0
    target2_atr: float = 2.0
    least_stop: float = 0.5
    max_minutes: int = 60
    stop_first: bool = True
    risk_usd: float = 100.0
    breakeven_r: float | None = None
    trail_r: float | None = None
    trail_atr: float | None = None
    idle_minutes: int | None = None
    idle_r: float | None = None
    long: bool = True
    short: bool = True
    slippage_atr: float = 0.0
    from_signal: bool = False
    historical: bool = False


_SCHEMA = "config_id string, threshold int, spread double, stop_atr double, target1_atr double, target2_atr double, least_stop double, max_minutes int, stop_first boolean, risk_usd double, breakeven_r double, trail_r double, trail_atr double, idle_minutes int, idle_r double, long boolean, short boolean, slippage_atr double, from_signal boolean, historical boolean"


def frame(spark: SparkSession, configs: list[Config]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(c).values()) for c in configs], _SCHEMA)


def _exit() -> Column:
    """The fold over the bars from entry on, in mirrored prices."""
    e, dist = F.col("_entry"), F.col("stop_dist")
    none = F.lit(None)
    start = F.struct(F.lit(None).cast("string").alias("result"), F.col("_stop").alias("stop"), F.lit(0.0).alias("mfe"), F.lit(0.0).alias("mae"), none.cast("double").alias("price"), none.cast("bigint").alias("t"))

    def step(a: Column, b: Column) -> Column:
        mfe, mae = F.greatest(a["mfe"], b["h"] - e), F.greatest(a["mae"], e - b["l"])
        r = mfe / dist
        stop = F.when(r >= F.col("breakeven_r"), F.greatest(a["stop"], e)).otherwise(a["stop"])
        stop = F.when(r >= F.col("trail_r"), F.greatest(stop, F.round(b["h"] - F.col("trail_atr") * F.col("atr"), 2))).otherwise(stop)
        minutes = (b["t"] - F.col("entry_time")) / 60
        held = F.when(F.col("from_signal"), (b["t"] - F.col("signal_time")) / 60).otherwise(minutes)
        one, two = b["h"] >= F.col("_t1"), b["h"] >= F.col("_t2")
        x = F.struct(stop.alias("stop"), mfe.alias("mfe"), mae.alias("mae"))
        # a fold over a single element names the values that are used several times
        named = F.try_element_at(
            F.transform(
                F.array(x),
                lambda s: F.struct(
                    F.when((b["l"] <= s["stop"]) & one, F.when(F.col("stop_first"), "STOP_LOSS").otherwise("TP1"))
                    .when(b["l"] <= s["stop"], "STOP_LOSS")
                    .when(two, "TP2")
                    .when(one, "TP1")
                    .when((minutes >= F.col("idle_minutes")) & (s["mfe"] / dist < F.col("idle_r")), "IDLE")
                    .when(held >= F.col("max_minutes"), "EXPIRED")
                    .alias("result"),
                    s.alias("s"),
                ),
            ),
            F.lit(1),
        )
        price = lambda y: F.when(y["result"] == "STOP_LOSS", y["s"]["stop"]).when(y["result"] == "TP1", F.col("_t1")).when(y["result"] == "TP2", F.col("_t2")).when(y["result"].isNotNull(), b["c"])
        moved = F.try_element_at(F.transform(F.array(named), lambda y: F.struct(y["result"].alias("result"), y["s"]["stop"].alias("stop"), y["s"]["mfe"].alias("mfe"), y["s"]["mae"].alias("mae"), price(y).alias("price"), F.when(y["result"].isNotNull(), b["t"]).alias("t"))), F.lit(1))
        return F.when(a["result"].isNotNull(), a).otherwise(moved)

    return F.aggregate(F.expr("slice(path, entry_k, size(path))"), start, step)


def candidates(signals: DataFrame, bars: DataFrame, configs: DataFrame, bar_seconds: int, policy: entries.Policy | None = None, causal: bool = True, max_minutes: int = 60) -> DataFrame:
    """Every signal under every configuration as if it were taken: entry, exit, return (REP2, REP4-9).

    max_minutes is the longest holding limit of the configurations; with the
    policy's wait it bounds the bars that are looked at. A signal with a value in
    only is for the configuration of this name alone. A signal that is not
    entered holds its slot to the bar of that decision. configs are few and made
    on the driver; they are broadcast.
    """
    policy = policy or entries.immediate()
    n = policy.wait + -(-max_minutes * 60 // bar_seconds) + 1
    paths = entries.with_path(signals, bars, n)
    if "only" not in paths.columns:
        paths = paths.withColumn("only", F.lit(None).cast("string"))
    mine = F.coalesce(F.col("only") == F.col("config_id"), F.lit(True))
    c = paths.join(F.broadcast(configs), mine & (F.col("strength") >= F.col("threshold")) & F.when(F.col("direction") == "LONG", F.col("long")).otherwise(F.col("short")))
    paid = lambda bar: F.when(F.col("historical"), F.coalesce(spread_dollars(bar["s"]), F.col("spread"))).otherwise(F.col("spread"))
    c = entries.evaluate(c, policy, causal, lambda bar: paid(bar) + F.col("slippage_atr") * F.col("atr"))
    round2 = lambda x: F.round(x, 2)
    c = c.withColumns({"_entry": F.col("sign") * F.col("entry_price"), "stop_dist": F.greatest(F.col("least_stop"), round2(F.col("atr") * F.col("stop_atr")))})
    c = c.withColumns({"_stop": round2(F.col("_entry") - F.col("stop_dist")), "_t1": round2(F.col("_entry") + round2(F.col("atr") * F.col("target1_atr"))), "_t2": round2(F.col("_entry") + round2(F.col("atr") * F.col("target2_atr")))})
    c = c.withColumn("_x", F.when(F.col("entry_time").isNotNull(), _exit()))
    r = round2((F.col("_x.price") - F.col("_entry")) / F.col("stop_dist"))
    sign = F.col("sign")
    return c.select(
        "symbol", "config_id", "policy", "signal_time", "direction", "strength", "trend", "status", "decided_time", "entry_time", "entry_price", "stop_dist",
        F.col("_x.t").alias("exit_time"),
        (sign * F.col("_x.price")).alias("exit_price"),
        (sign * F.col("_x.stop")).alias("stop_loss"),
        (sign * F.col("_t1")).alias("target"),
        F.when(F.col("_x.result") == "IDLE", "EXPIRED").otherwise(F.col("_x.result")).alias("result"),
        (F.col("_x.result") == "IDLE").alias("idle"),
        r.alias("r_multiple"),
        round2(r * F.col("risk_usd")).alias("pnl"),
        F.round(F.greatest(F.lit(1.0), (F.col("_x.t") - F.col("entry_time")) / 60), 1).alias("holding_minutes"),
        round2(F.col("_x.mfe") / F.col("stop_dist")).alias("mfe_r"),
        round2(F.col("_x.mae") / F.col("stop_dist")).alias("mae_r"),
    )


def select_trades(cands: DataFrame, keep_missed: bool = False, span: int = 0) -> DataFrame:
    """The candidates that one open position takes (REP1, ENT9), with taken; without keep_missed only trades that closed.

    A candidate holds the slot from its signal to its exit, or to the bar on
    which it was given up; the bar of an exit may give the next signal. The
    taken ones are a chain of such spans (plans.chains), followed in time blocks
    in parallel. span is the usual length of one in seconds, a day if 0.
    """
    free = F.coalesce(F.when(F.col("status").startswith("ENTERED"), F.coalesce("exit_time", F.lit(NEVER))).when(F.col("status") == "WAITING", F.lit(NEVER)), F.col("decided_time"))
    out = chained(cands.withColumn("_free", free.cast("long")), ["symbol", "config_id", "policy"], "signal_time", "_free", 4 * (span or 86400)).drop("_free")
    if keep_missed:
        return out
    closed = out.where("taken AND exit_time IS NOT NULL")
    return closed.withColumns({"trade_id": F.concat_ws("|", "symbol", "entry_time", "direction"), "session": classify.session("entry_time"), "r_h": F.round(F.col("r_multiple") * 100).cast("long")})


def replay(signals: DataFrame, bars: DataFrame, configs: DataFrame, bar_seconds: int, policy: entries.Policy | None = None, causal: bool = True, max_minutes: int = 60) -> DataFrame:
    """The trades of every configuration (REP1); VAL4-6 are configurations that differ in one value."""
    return select_trades(candidates(signals, bars, configs, bar_seconds, policy, causal, max_minutes), span=60 * max_minutes)


def conversion(chosen: DataFrame) -> DataFrame:
    """For each policy what became of the signals that found the slot free (ENT9)."""
    return chosen.where("taken").groupBy("config_id", "policy").agg(F.count(F.lit(1)).alias("signals"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("ENTERED_IMMEDIATELY", "ENTERED_AFTER_DELAY", "INVALIDATED", "TIMED_OUT")], F.round(F.avg((F.col("entry_time") - F.col("signal_time")) / 60), 6).alias("mean_delay"))


def spread_dollars(spread: Column) -> Column:
    """A stored spread in dollars: values over 2 are points of a hundredth (REP3)."""
    return F.when(spread > 2, spread * 0.01).otherwise(spread)


def improvement(base: DataFrame, other: DataFrame) -> DataFrame:
    """How much better other entered the same signals than base, in units of risk (ENT10)."""
    a = base.select("symbol", "signal_time", "direction", F.col("entry_price").alias("p"), "stop_dist")
    b = other.select("symbol", "signal_time", F.col("entry_price").alias("q"))
    gain = F.when(F.col("direction") == "LONG", F.col("p") - F.col("q")).otherwise(F.col("q") - F.col("p")) / F.col("stop_dist")
    return a.join(b, ["symbol", "signal_time"]).agg(F.count(F.lit(1)).alias("matched"), F.round(F.avg(gain), 6).alias("mean_r"), F.round(F.median(gain), 6).alias("median_r"))


def parse_time(value: Column) -> Column:
    """Seconds from digits (milliseconds over 10^10), ISO text or its first ten characters, in UTC; null if none fits (REP12)."""
    s = F.transform(F.array(value.cast("string")), lambda v: F.coalesce(v.try_cast("long"), F.unix_timestamp(F.try_to_timestamp(v)), F.unix_timestamp(F.try_to_timestamp(F.substring(v, 1, 10), F.lit("yyyy-MM-dd")))))
    x = F.try_element_at(s, F.lit(1))
    return F.when(x > 10_000_000_000, F.floor(x / 1000)).otherwise(x).cast("long")
