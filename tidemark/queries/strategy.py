"""Indicators, signals, entries, replay and what is built on them, over hourly and five-hourly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators import classify, entries, experiments, forensics, montecarlo, replay, signals, stats, study, windows
from tidemark.plans.joins import as_of
from tidemark.queries.ledger import _EQ, _HEAD, _T
from tidemark.queries.market import _B, _BP, H, P
from tidemark.session import shared_folder, written
from tidemark.sources import adapters as A

#: Bars are hours here: a limit of 60 bars is 3600 minutes, and scores are lower than with minute bars.
LIMIT, THRESHOLD = 3600, 5


#: Spreads of the sweeps: those of minute bars, whose ATR is some two units, times 25, as hours here move by fifty.
SPREADS = [2.5, 5.0, 7.5, 10.0, 12.5, 18.75]


def _closes() -> F.Column:
    return F.transform("win", lambda b: b["close"])


def ind1_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = I.sliding(A.bars(spark, sf_dir), I.TRIGGER_SLICE)
    return b.select("symbol", "epoch_s", *[I.ema(_closes(), n).alias(f"ema{n}") for n in (9, 21, 50)])


def ind1_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.ema_series(A.bars(spark, sf_dir), 21)


def ind3_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sliding(A.bars(spark, sf_dir), I.TRIGGER_SLICE).select("symbol", "epoch_s", I.rsi(_closes()).alias("rsi"))


def ind4_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sliding(A.bars(spark, sf_dir), I.TRIGGER_SLICE).select("symbol", "epoch_s", I.macd(_closes()).alias("m")).select("symbol", "epoch_s", "m.*")


def ind5_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sliding(A.bars(spark, sf_dir), I.TRIGGER_SLICE).select("symbol", "epoch_s", I.atr(F.col("win")).alias("atr"))


def ind6_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sliding(A.bars(spark, sf_dir), I.TRIGGER_SLICE).select("symbol", "epoch_s", I.vwap(F.col("win"), 9).alias("vwap"))


def ind7_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pivots(A.bars(spark, sf_dir)).where("pivot_high OR pivot_low").select("symbol", "epoch_s", "high", "low", "pivot_high", "pivot_low")


def ind8_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("win")
    b = I.sliding(A.bars(spark, sf_dir), I.PRIMARY_SLICE).withColumns({"h": I.pivot_prices(w, "high"), "l": I.pivot_prices(w, "low")})
    return b.select("symbol", "epoch_s", I.structure(w, F.col("h"), F.col("l")).alias("structure"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.features(A.bars(spark, sf_dir), A.bars(spark, sf_dir, P), H, P)


def ind9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    both = f.select("symbol", "epoch_s", F.posexplode(F.concat("supports", "resistances")).alias("place", "x"))
    return both.select("symbol", "epoch_s", "place", "x.*")


def sig3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals.score(_features(spark, sf_dir), THRESHOLD)
    return s.select("symbol", "epoch_s", "type", "strength", "long_score", "short_score", "trend", "structure", "reasons", "warnings")


def sig6_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.bars(spark, sf_dir, P).select("symbol", (F.col("epoch_s") + P - H).alias("known_s"), F.col("close").alias("close5"))
    return as_of(A.bars(spark, sf_dir).select("symbol", "epoch_s", "close"), p, ["symbol"], "epoch_s", "known_s", ["close5"])


def sig10_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals.score_v2(_features(spark, sf_dir), 6.0)
    return s.select("symbol", "epoch_s", "type_v2", "strength_v2", "long_v2", "short_v2", "regime", "atr_regime", "overextended")


def cls3_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.bars(spark, sf_dir).withColumn("range", F.round(F.col("high") - F.col("low"), 2))
    return classify.with_volatility(b, "range").select("symbol", "epoch_s", "quintile")


def cls4_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of bars of several ticks, carried over bars of one."""
    b = A.bars(spark, sf_dir).withColumn("range", F.when(F.col("tick_volume") > 1, F.round(F.col("high") - F.col("low"), 2)))
    return classify.filled(b, "range").select("symbol", "epoch_s", "range")


def cls5_impulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = I.sliding(A.bars(spark, sf_dir), I.TRIGGER_SLICE).withColumns({"ema21": I.ema(_closes(), 21), "ema50": I.ema(_closes(), 50), "atr": I.atr(F.col("win"))}).drop("win")
    b = b.withColumn("direction", F.when(F.floor(F.col("epoch_s") / H) % 2 == 0, "LONG").otherwise("SHORT"))
    b = classify.with_impulse(b, "direction")
    return b.where("ema50 IS NOT NULL").groupBy("symbol", "direction", "state").agg(F.count(F.lit(1)).alias("n"))


def _simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar as a signal with its own ATR, in whole units, and average, cut to hundredths: multiples are then exact in the SQL twins too."""
    k = F.floor(F.col("epoch_s") / H)
    b = I.sliding(A.bars(spark, sf_dir), I.TRIGGER_SLICE).withColumns({"atr": F.greatest(F.lit(1.0), F.round(F.coalesce(I.atr(F.col("win")), F.lit(1.5)))), "ema21": F.floor(I.ema(_closes(), 21) * 100) / 100}).drop("win")
    return b.select("symbol", F.col("epoch_s").alias("signal_time"), F.when(k % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), F.lit(10).alias("strength"), "atr", F.lit("RANGE").alias("trend"), F.col("close").alias("signal_close"), F.col("high").alias("signal_high"), F.col("low").alias("signal_low"), "ema21")


def _entries(spark: SparkSession, sf_dir: str, policy: entries.Policy, causal: bool) -> DataFrame:
    paths = entries.with_path(_simple(spark, sf_dir), A.bars(spark, sf_dir), policy.wait)
    return entries.evaluate(paths, policy, causal).select("symbol", "signal_time", "direction", "status", "entry_time", "entry_price")


def ent1_immediate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir, entries.immediate(), True)


def ent2_retrace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir, entries.retrace(), False)


def ent2_retrace_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir, entries.retrace(), True)


def ent3_reversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir, entries.reversion(), False)


def ent4_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir, entries.momentum(), False)


def ent5_breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir, entries.breakout(), False)


def ent6_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir, entries.hybrid(), False)


def ent7_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir, entries.tight(), False)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.signals(signals.score(_features(spark, sf_dir), THRESHOLD))


def _stored_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals as a table, for queries that replay them several times."""
    s, at = _signals(spark, sf_dir), shared_folder(spark, "signals")
    s.write.parquet(at)
    return spark.read.schema(s.schema).parquet(at)


def _base(**more: object) -> replay.Config:
    return replay.Config(threshold=THRESHOLD, max_minutes=LIMIT, **more)


def rep1_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay(_signals(spark, sf_dir), A.bars(spark, sf_dir), replay.frame(spark, [_base()]), H, max_minutes=LIMIT)


def rep5_managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [_base(config_id="managed", breakeven_r=0.5, trail_r=0.75, trail_atr=0.5, idle_minutes=600, idle_r=0.2), _base(config_id="targets_first", stop_first=False)]
    return replay.replay(_signals(spark, sf_dir), A.bars(spark, sf_dir), replay.frame(spark, c), H, max_minutes=LIMIT)


def _sweep(spark: SparkSession, sf_dir: str, configs: list) -> DataFrame:
    t = replay.replay(_signals(spark, sf_dir), A.bars(spark, sf_dir), replay.frame(spark, configs), H, max_minutes=LIMIT)
    return stats.headline(t, ["config_id"])


def val2_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.with_warmup(A.bars(spark, sf_dir), 1704672000, 1705276800, 50).select("symbol", "epoch_s", "close")


def rep12_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of ticks as text in four forms, read back."""
    k, s = F.col("seq") % 4, F.col("epoch_s").cast("string")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("epoch_s") / 86400).cast("int")).cast("string")
    text = F.when(k == 0, s).when(k == 1, F.concat(s, F.lit("250"))).when(k == 2, F.concat(day, F.lit(" and more"))).otherwise("none")
    return A.ticks(spark, sf_dir).select("seq", replay.parse_time(text).alias("time"))


def val4_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir, experiments.sweep(_base(), "spread", SPREADS))


def val5_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.small_samples(_sweep(spark, sf_dir, experiments.sweep(_base(), "threshold", [5, 6, 7, 8])))


def val6_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir, experiments.exit_profiles(_base()))


def val7_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return montecarlo.summary(montecarlo.simulate(A.trades(spark, sf_dir)))


def val8_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.long_trades(spark, sf_dir).withColumn("book", F.col("trade_id") % 3)
    return experiments.flags(experiments.facts(t, ["book"]), ["book"])


#: Walk-forward windows of the month of bars: ten days to train, five to validate.
SLICES = windows.slices(1_703_980_800, 1_706_659_200, 10, 5, 5)


def _study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.replayed(_signals(spark, sf_dir), A.bars(spark, sf_dir), study.sweeps(_base(), SPREADS, [5, 6, 7, 8]), SLICES, H, LIMIT)


def val9_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen configurations over all trades, by window and by stage: features are computed once."""
    return study.figures(_study(spark, sf_dir))


def val9_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags that the sweeps of the study raise."""
    return experiments.flags(study.facts(_study(spark, sf_dir), "baseline", SLICES), [])


def val9_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study's figures over the long ledger, three books for configurations."""
    t = A.long_trades(spark, sf_dir).withColumn("config_id", F.concat(F.lit("book "), F.col("trade_id") % 3))
    return study.figures(study.staged(t, windows.slices(788918400, 996624000, 360, 180, 180)))


def _replayed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline's trades with what was known at their signals and what the price did after them."""
    f = written(_features(spark, sf_dir), "features")
    t = replay.replay(signals.signals(signals.score(f, THRESHOLD)), A.bars(spark, sf_dir), replay.frame(spark, [_base()]), H, max_minutes=LIMIT)
    t = forensics.later_moves(forensics.snapshot(written(t, "trades"), f), A.bars(spark, sf_dir), 60 * LIMIT)
    regime = classify.regime("trend", "structure", "to_ema50")
    return t.withColumns({"mfe": F.col("mfe_r") * F.col("stop_dist"), "regime": regime})


def for4_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure tags of the trades that replay made, by their own signals."""
    return forensics.category_counts(forensics.failure_tags(_replayed_ledger(spark, sf_dir), 7.5))


def for7_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contrast of conditions over the trades that replay made."""
    return forensics.contrast(_replayed_ledger(spark, sf_dir), {name: c() for name, c in forensics.CONDITIONS.items()})


def exp3_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = [_base()] + [replay.Config(**({"threshold": THRESHOLD, "max_minutes": LIMIT, "config_id": e.id} | e.changes)) for e in experiments.EXPERIMENTS]
    t = replay.replay(experiments.tagged_signals(_features(spark, sf_dir), THRESHOLD), A.bars(spark, sf_dir), replay.frame(spark, configs), H, max_minutes=LIMIT)
    return experiments.compare(t)


def exp2_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals.score(_features(spark, sf_dir), THRESHOLD).where("type <> 'WAIT'")
    return s.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(experiments.keep(e.filter, e.value)).alias(e.filter) for e in experiments.EXPERIMENTS if e.filter])


def exp4_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    parts = [signals.score(f, THRESHOLD, frozenset(e.without)).withColumn("id", F.lit(e.id)) for e in (experiments.Experiment("baseline", ""), *(x for x in experiments.EXPERIMENTS if x.without))]
    both = parts[0].select("id", "type", "strength")
    for p in parts[1:]:
        both = both.unionByName(p.select("id", "type", "strength"))
    return both.groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("strength").alias("strength"))


def ent9_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig, bars, cfg = _stored_signals(spark, sf_dir), A.bars(spark, sf_dir), replay.frame(spark, [_base()])
    out = None
    for make in entries.POLICIES:
        c = replay.select_trades(replay.candidates(sig, bars, cfg, H, make(), True, LIMIT), keep_missed=True)
        out = c if out is None else out.unionByName(c)
    return replay.conversion(out)


def ent10_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig, bars, cfg = _stored_signals(spark, sf_dir), A.bars(spark, sf_dir), replay.frame(spark, [_base()])
    a, b = (replay.replay(sig, bars, cfg, H, p, True, LIMIT) for p in (entries.immediate(), entries.tight()))
    return replay.improvement(a, b)


def aud4_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell is simulated anew: depth of the pull-back by bars waited."""
    sig, bars, cfg = _stored_signals(spark, sf_dir), A.bars(spark, sf_dir), replay.frame(spark, [_base()])
    out = None
    for depth in (0.10, 0.15, 0.20):
        for wait in (1, 2, 3):
            t = replay.replay(sig, bars, cfg, H, entries.retrace(depth, wait, 0.75, f"retrace {depth} {wait}"), True, LIMIT)
            out = t if out is None else out.unionByName(t)
    return stats.headline(out, ["policy"])


def aud1_same_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar as an entry at its open, with stop and target 10 away; the target counts first, so doubtful trades differ."""
    k = F.floor(F.col("epoch_s") / H)
    b = A.bars(spark, sf_dir)
    sign = F.when(k % 2 == 0, 1).otherwise(-1)
    t = b.withColumns({"direction": F.when(k % 2 == 0, "LONG").otherwise("SHORT"), "entry_price": F.col("open"), "stop_loss": F.round(F.col("open") - sign * 10, 2), "target": F.round(F.col("open") + sign * 10, 2)})
    one = F.when(sign > 0, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    stop = F.when(sign > 0, F.col("low") <= F.col("stop_loss")).otherwise(F.col("high") >= F.col("stop_loss"))
    t = t.withColumn("result", F.when(one, "TP1").when(stop, "STOP_LOSS").otherwise("EXPIRED"))
    t = t.select("symbol", F.col("epoch_s").alias("entry_time"), (F.col("epoch_s") + F.when(F.col("result") == "EXPIRED", H).otherwise(0)).alias("exit_time"), "direction", "entry_price", "stop_loss", "target", "result", F.when(one, 100).when(stop, -100).otherwise(0).cast("long").alias("r_h"))
    return forensics.same_bar(t, b, ["symbol", "direction"])


def aud3_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holding limit from the entry and from the signal, for entries that wait."""
    configs = [_base(config_id="entry"), _base(config_id="signal", from_signal=True)]
    t = replay.replay(_signals(spark, sf_dir), A.bars(spark, sf_dir), replay.frame(spark, configs), H, entries.retrace(), True, LIMIT)
    return stats.headline(t, ["config_id"])


def aud4_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slippage and spread simulated anew."""
    return _sweep(spark, sf_dir, experiments.sweep(_base(), "slippage_atr", [0.0, 0.02, 0.05, 0.1]) + experiments.sweep(_base(), "spread", SPREADS[1:4]) + [_base(config_id="historical", historical=True)])


def cls8_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.floor(F.col("epoch_s") / H) % 2 == 0, "LONG").otherwise("SHORT")
    c = signals.components(_features(spark, sf_dir).withColumn("direction", d))
    return c.groupBy("symbol", "direction").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(x).alias(x) for x in c.columns if x.startswith("has_")])


def oos1_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.verdict(stats.headline(A.trades(spark, sf_dir), ["symbol"]), ["symbol"])


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor(F.col("epoch_s") / H)
    b = A.bars(spark, sf_dir)
    return b.select("symbol", F.col("epoch_s").alias("entry_time"), (F.col("epoch_s") + H * (1 + k % 24)).alias("exit_time"), F.when(k % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), F.col("open").alias("entry_price"), F.lit(40.0).alias("risk"), F.concat_ws("|", "symbol", "epoch_s").alias("trade_id"))


def for1_excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forensics.excursions(_positions(spark, sf_dir), A.bars(spark, sf_dir), 24 * H).select("symbol", "trade_id", "bars", "mfe", "mae", "mfe_r", "mae_r", "stop_s")


def _forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.floor(F.col("epoch_s") / H) % 2 == 0, "LONG").otherwise("SHORT")
    return forensics.forward(A.bars(spark, sf_dir).withColumn("direction", d), d, (1, 5, 60))


def for14_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forward(spark, sf_dir).where("mfe1 IS NOT NULL").select("symbol", "epoch_s", "direction", *[f"{m}{n}" for n in (1, 5, 60) for m in ("mfe", "mae")])


def for13_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar as a trade over the next bar, risk 40, and what the next sixty did."""
    f = _forward(spark, sf_dir).where("mfe1 IS NOT NULL").withColumns({"r_h": F.round((F.col("mfe1") - F.col("mae1")) * 2.5).cast("long"), "holding_minutes": 1 + F.floor(F.col("epoch_s") / H) % 6, "mfe_r": F.col("mfe60") / 40, "mae_r": F.col("mae60") / 40})
    return f.groupBy("symbol", "direction", forensics.outcome_group().alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("r_h").alias("r_h"))


def for16_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _forward(spark, sf_dir).where("mfe1 IS NOT NULL")
    unit = F.lit(80.0)
    return f.groupBy(forensics.path_label(F.col("mae1") / unit, F.col("mfe5") / unit, F.col("mae5") / unit).alias("label"), "direction").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {k: f for k, f in list(globals().items()) if k[:3] in ("ind", "sig", "cls", "ent", "rep", "val", "exp", "aud", "oos", "for") and k[3:4].isdigit()}

_WINS = f"{_B}, wins AS (SELECT symbol, epoch_s, list(close) OVER w AS c, list({{'h': high, 'l': low, 'c': close, 'v': tick_volume}}) OVER w AS b FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY epoch_s ROWS 120 PRECEDING))"
_EMA = lambda n, c="c": f"CASE WHEN len({c}) >= {n} THEN round(list_reduce(list_slice({c}, {n + 1}, len({c})), lambda a, x: x * {2 / (n + 1)!r} + a * {1 - 2 / (n + 1)!r}, list_sum(list_slice({c}, 1, {n})) / {n}), 4) END"
_WILDER = lambda v: f"list_reduce(list_slice({v}, 15, len({v})), lambda a, x: (a * 13 + x) / 14, list_sum(list_slice({v}, 1, 14)) / 14)"
_ATR = f"tr AS (SELECT symbol, epoch_s, c, len(b) AS n, list_transform(range(1, len(b) + 1), lambda i: CASE WHEN i = 1 THEN b[1].h - b[1].l ELSE greatest(b[i].h - b[i].l, abs(b[i].h - b[i - 1].c), abs(b[i].l - b[i - 1].c)) END) AS t FROM wins)"
#: The averages of a window step by step: fast and slow, their difference, its average.
_MACD = f"""{_WINS.replace("WITH ", "WITH RECURSIVE ", 1)}, folded AS (
 SELECT symbol, epoch_s, c, len(c) AS n, 0 AS i, 0.0::DOUBLE AS total, 0.0::DOUBLE AS f, 0.0::DOUBLE AS s, 0.0::DOUBLE AS line, 0.0::DOUBLE AS lines, 0.0::DOUBLE AS g FROM wins WHERE len(c) >= 35 UNION ALL
 SELECT symbol, epoch_s, c, n, i, total, f, s, line, lines + line AS lines, CASE WHEN i < 34 THEN 0.0 WHEN i = 34 THEN (lines + line) / 9 ELSE line * {2 / 10!r} + g * {1 - 2 / 10!r} END AS g FROM
 (SELECT *, CASE WHEN i >= 26 THEN round(f, 4) - round(s, 4) ELSE 0.0 END AS line FROM
 (SELECT symbol, epoch_s, c, n, i + 1 AS i, total + c[i + 1] AS total, lines, g,
 CASE WHEN i + 1 < 12 THEN 0.0 WHEN i + 1 = 12 THEN (total + c[i + 1]) / 12 ELSE c[i + 1] * {2 / 13!r} + f * {1 - 2 / 13!r} END AS f,
 CASE WHEN i + 1 < 26 THEN 0.0 WHEN i + 1 = 26 THEN (total + c[i + 1]) / 26 ELSE c[i + 1] * {2 / 27!r} + s * {1 - 2 / 27!r} END AS s FROM folded WHERE i < n)))"""
_IMPULSE = f"""{_WINS}, {_ATR}, x AS (SELECT symbol, epoch_s, {_EMA(21)} AS ema21, {_EMA(50)} AS ema50, greatest(0.1, CASE WHEN n > 14 THEN round({_WILDER("t")}, 4) END) AS unit FROM tr),
 y AS (SELECT *, CASE WHEN (epoch_s // {H}) % 2 = 0 THEN 1 ELSE -1 END AS g, row_number() OVER w AS k, {", ".join(f"lag({c}, {j}) OVER w AS {c[0]}{j}" for c in ("open", "close") for j in (1, 2))} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY epoch_s)),
 z AS (SELECT *, g * (close - ema21) / unit AS d21, g * (close - ema50) / unit AS d50, abs(close - o1) / unit AS move2, abs(close - o2) / unit AS move3, CAST(g * (close - open) > 0 AS INT) + CAST(g * (c1 - o1) > 0 AS INT) + CAST(g * (c2 - o2) > 0 AS INT) AS along FROM y JOIN x USING (symbol, epoch_s) WHERE ema50 IS NOT NULL),
 told AS (SELECT symbol, CASE WHEN g > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, CASE WHEN k <= 5 THEN 'NEUTRAL' WHEN d21 > 0.9 OR move3 > 1.8 OR (along = 3 AND d21 > 0.7) THEN 'LATE_IMPULSE' WHEN d21 <= 0.35 AND d50 >= 0 THEN 'CONTROLLED_PULLBACK' WHEN d21 >= 0.2 AND d21 <= 0.7 AND move2 <= 1 AND along <= 2 THEN 'EARLY_IMPULSE' ELSE 'NEUTRAL' END AS state FROM z)"""
_SIMPLE = f"""{_WINS}, {_ATR}, unit AS (SELECT symbol, epoch_s, greatest(1.0, round(coalesce(CASE WHEN n > 14 THEN round({_WILDER("t")}, 4) END, 1.5))) AS atr, floor({_EMA(21)} * 100) / 100 AS ema FROM tr),
 nb AS (SELECT *, {', '.join(f'lead({c}, {k}) OVER w AS {c}{k}' for k in range(1, 6) for c in ('epoch_s', 'open', 'high', 'low', 'close'))} FROM bars JOIN unit USING (symbol, epoch_s) WINDOW w AS (PARTITION BY symbol ORDER BY epoch_s)),
 s AS (SELECT symbol, epoch_s AS signal_time, CASE WHEN (epoch_s // {H}) % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, CASE WHEN (epoch_s // {H}) % 2 = 0 THEN 1 ELSE -1 END AS g, * EXCLUDE (symbol, epoch_s) FROM nb WHERE epoch_s1 IS NOT NULL),
 m AS (SELECT symbol, signal_time, direction, g, atr, g * coalesce(ema, close) AS ema, g * close AS ref, CASE WHEN g > 0 THEN high ELSE -low END AS top, CASE WHEN g > 0 THEN low ELSE -high END AS bottom, {', '.join(f"epoch_s{k} AS t{k}, g * open{k} AS o{k}, CASE WHEN g > 0 THEN high{k} ELSE -low{k} END AS h{k}, CASE WHEN g > 0 THEN low{k} ELSE -high{k} END AS l{k}, g * close{k} AS c{k}" for k in range(1, 6))} FROM s)"""


def _sql_entry(wait: int, rules: list[tuple[str, str | None]], immediate_ok: bool) -> str:
    """rules: (condition, price; None is invalidation) with # for the bar's number, tested in order bar by bar."""
    status, time, price = [], [], []
    for k in range(1, wait + 1):
        status.append(f"WHEN t{k} IS NULL THEN 'WAITING'")
        time.append(f"WHEN t{k} IS NULL THEN NULL")
        price.append(f"WHEN t{k} IS NULL THEN NULL")
        for cond, p in rules:
            c = cond.replace("#", str(k))
            if p is None:
                status.append(f"WHEN {c} THEN 'INVALIDATED'")
                time.append(f"WHEN {c} THEN NULL")
                price.append(f"WHEN {c} THEN NULL")
            else:
                x = p.replace("#", str(k))
                now = f"CASE WHEN o1 <= round({x}, 2) THEN 'ENTERED_IMMEDIATELY' ELSE 'ENTERED_AFTER_DELAY' END" if k == 1 and immediate_ok else "'ENTERED_AFTER_DELAY'"
                status.append(f"WHEN {c} THEN {now}")
                time.append(f"WHEN {c} THEN t{k}")
                price.append(f"WHEN {c} THEN round(g * (round({x}, 2) + 0.3), 2)")
    return f"{_SIMPLE} SELECT symbol, signal_time, direction, CASE {' '.join(status)} ELSE 'TIMED_OUT' END AS status, CASE {' '.join(time)} END AS entry_time, CASE {' '.join(price)} END AS entry_price FROM m"


_FWD = f"""{_B}, d AS (SELECT *, (epoch_s // {H}) % 2 = 0 AS long_, {', '.join(f'max(high) OVER (PARTITION BY symbol ORDER BY epoch_s ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) AS hi{n}, min(low) OVER (PARTITION BY symbol ORDER BY epoch_s ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) AS lo{n}' for n in (1, 5, 60))} FROM bars),
 f AS (SELECT symbol, epoch_s, CASE WHEN long_ THEN 'LONG' ELSE 'SHORT' END AS direction, {', '.join(f'round(greatest(0, CASE WHEN long_ THEN hi{n} - close ELSE close - lo{n} END), 6) AS mfe{n}, round(greatest(0, CASE WHEN long_ THEN close - lo{n} ELSE hi{n} - close END), 6) AS mae{n}' for n in (1, 5, 60))} FROM d WHERE hi1 IS NOT NULL)"""

_R = lambda hit, n: f"coalesce(round(count(*) FILTER ({hit}) * 100 / nullif(count(*) FILTER ({n}), 0), 6), 0.0::DOUBLE)"
_FACTS = f"""WITH {A.SQL_LONG.replace('trades AS', 'ledger AS', 1)}, trades AS (SELECT *, trade_id % 3 AS book, min(entry_time) OVER (PARTITION BY trade_id % 3) AS from_ FROM ledger), {_EQ('book')},
 o AS (SELECT book, (max(exit_time) - min(entry_time)) // 86400 AS history_days, count(DISTINCT day) AS days, count(*) AS trades, sum(r_h)::DOUBLE / 100 AS total_r, count(*) FILTER (entry_time >= from_ + 7776000) AS oos_trades,
 coalesce(sum(r_h) FILTER (entry_time >= from_ + 7776000), 0)::DOUBLE / 100 AS oos_total_r, round(avg(r_h) FILTER (entry_time >= from_ + 7776000) / 100, 6) AS oos_average_r, round(avg(r_h) / 100, 6) AS low_spread_average_r, round(avg(r_h - 10) / 100, 6) AS high_spread_average_r,
 sum(r_h)::DOUBLE / 100 AS low_spread_total_r, sum(r_h - 10)::DOUBLE / 100 AS high_spread_total_r, {_R('r_h > 0', 'true')} AS low_threshold_win_rate, {_R('r_h > 0 AND strength >= 10', 'strength >= 10')} AS high_threshold_win_rate, count(*) AS low_threshold_trades, count(*) FILTER (strength >= 10) AS high_threshold_trades,
 least(sum(least(r_h, 100)), sum(least(r_h, 150)), sum(r_h))::DOUBLE / 100 AS min_exit_total_r, greatest(sum(least(r_h, 100)), sum(least(r_h, 150)), sum(r_h))::DOUBLE / 100 AS max_exit_total_r,
 {', '.join(f"count(*) FILTER (direction = '{s}') AS {s}_trades, {_R(f"direction = '{s}' AND r_h > 0", f"direction = '{s}'")} AS {s}_win_rate, coalesce(sum(r_h) FILTER (direction = '{s}'), 0)::DOUBLE / 100 AS {s}_total_r" for s in ('LONG', 'SHORT'))} FROM trades GROUP BY 1),
 m AS (SELECT book, coalesce(round(greatest(max(m), 0) * 100 / nullif(sum(greatest(m, 0)), 0), 6), 0.0::DOUBLE) AS top1_pct FROM (SELECT book, strftime(make_timestamp(entry_time * 1000000), '%Y-%m') AS month, sum(r_h)::DOUBLE AS m FROM trades GROUP BY 1, 2) GROUP BY 1),
 q AS (SELECT book, max(drawdown_pct) AS max_drawdown_pct FROM eq GROUP BY 1),
 facts AS (SELECT *, days >= history_days AS complete, greatest(0, (history_days - 90) // 30) AS windows FROM o JOIN m USING (book) JOIN q USING (book))"""

#: The flags as they are meant, in words of their own: name, severity, fact, condition.
_FLAGS_MEANT = (
    ("INSUFFICIENT_HISTORY", "CAUTION", "history_days", "180 > history_days"),
    ("LIMITED_HISTORY", "INFO", "history_days", "history_days BETWEEN 180 AND 349"),
    ("INCOMPLETE_DATASET", "WARNING", "complete", "complete = false"),
    ("INSUFFICIENT_OOS_WINDOWS", "CAUTION", "windows", "windows = 0"),
    ("INSUFFICIENT_OOS_WINDOWS", "WARNING", "windows", "windows BETWEEN 1 AND 5"),
    ("LOW_SAMPLE_SIZE", "WARNING", "trades", "30 > trades"),
    ("LOW_OOS_SAMPLE", "INFO", "oos_trades", "30 > oos_trades AND windows > 0"),
    ("NEGATIVE_OOS_EXPECTANCY", "WARNING", "oos_total_r", "windows > 0 AND least(oos_average_r, oos_total_r) < 0"),
    ("HIGH_SPREAD_SENSITIVITY", "WARNING", "high_spread_total_r", "low_spread_average_r >= high_spread_average_r + 0.12 OR (0 > high_spread_total_r AND 0 < low_spread_total_r)"),
    ("HIGH_THRESHOLD_SENSITIVITY", "INFO", "high_threshold_win_rate", "high_threshold_win_rate NOT BETWEEN low_threshold_win_rate - 20 AND low_threshold_win_rate + 20 OR (low_threshold_trades > 29 AND high_threshold_trades < 10)"),
    ("HIGH_EXIT_SENSITIVITY", "INFO", "max_exit_total_r", "max_exit_total_r > 10 + min_exit_total_r"),
    ("HIGH_PERIOD_CONCENTRATION", "WARNING", "top1_pct", "total_r > 0 AND 50 < top1_pct"),
    ("DIRECTIONAL_ASYMMETRY", "INFO", "long_win_rate", "least(long_trades, short_trades) > 5 AND (long_win_rate NOT BETWEEN short_win_rate - 15 AND short_win_rate + 15 OR sign(long_total_r) * sign(short_total_r) = -1)"),
    ("HIGH_DRAWDOWN", "CAUTION", "max_drawdown_pct", "NOT max_drawdown_pct < 15"),
)

ORACLES = {
    "val8_flags": f"{_FACTS} " + " UNION ALL ".join(f"SELECT book, '{n}' AS flag, '{s}' AS severity, '{x}' AS fact, round({x}::DOUBLE, 6) AS value FROM facts WHERE {c}" for n, s, x, c in _FLAGS_MEANT),
    "val9_ledger": f"""WITH {A.SQL_LONG}, w(i, lo, hi) AS (VALUES {', '.join(f'({i}, {lo}, {hi})' for i, _, _, lo, hi in windows.slices(788918400, 996624000, 360, 180, 180))}),
 t AS (SELECT 'book ' || (trade_id % 3) AS config_id, r_h, (SELECT i FROM w WHERE entry_time >= lo AND entry_time < hi) AS window_index, CASE WHEN entry_time < (SELECT max(lo) FROM w) THEN 'development' ELSE 'final' END AS stage FROM trades),
 g AS (SELECT config_id, NULL AS window_index, NULL AS stage, 'all' AS scope, r_h FROM t UNION ALL SELECT config_id, window_index, NULL, 'window', r_h FROM t WHERE window_index IS NOT NULL UNION ALL SELECT config_id, NULL, stage, 'stage', r_h FROM t)
 SELECT config_id, window_index, stage, scope, count(*) AS trades, count(*) FILTER (r_h > 0) AS wins, sum(r_h)::DOUBLE / 100 AS total_r, round(avg(r_h) / 100, 6) AS average_r, CASE WHEN sum(r_h) FILTER (r_h < 0) < 0 THEN round(coalesce(sum(r_h) FILTER (r_h > 0), 0) / -sum(r_h) FILTER (r_h < 0), 6) WHEN count(*) FILTER (r_h > 0) > 0 THEN 999.0 ELSE 0.0 END AS profit_factor FROM g GROUP BY 1, 2, 3, 4""",
    "oos1_verdict": f"{_T}, h AS (SELECT symbol, {_HEAD()} FROM trades GROUP BY 1) SELECT symbol, trades, total_r, profit_factor, CASE WHEN trades < 100 THEN 'INCONCLUSIVE' WHEN average_r > 0 AND profit_factor >= 1.05 AND total_r > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM h",
    "cls4_filled": f"{_B}, r AS (SELECT symbol, epoch_s, CASE WHEN tick_volume > 1 THEN round(high - low, 2) END AS v FROM bars) SELECT symbol, epoch_s, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY epoch_s ROWS UNBOUNDED PRECEDING), 1.5::DOUBLE) AS range FROM r",
    "val2_warmup": f"{_B}, n AS (SELECT symbol, epoch_s, close, row_number() OVER (PARTITION BY symbol, epoch_s < 1704672000 ORDER BY epoch_s DESC) AS k FROM bars) SELECT symbol, epoch_s, close FROM n WHERE epoch_s BETWEEN 1704672000 AND 1705276800 OR (epoch_s < 1704672000 AND k <= 50)",
    "rep12_times": f"WITH {A.SQL_TICKS} SELECT seq, CASE seq % 4 WHEN 0 THEN epoch_s WHEN 1 THEN epoch_s WHEN 2 THEN epoch_s // 86400 * 86400 END AS time FROM ticks",
    "ind1_ema": f"{_WINS} SELECT symbol, epoch_s, {', '.join(f'{_EMA(n)} AS ema{n}' for n in (9, 21, 50))} FROM wins",
    "ind1_series": f"{_B}, wins AS (SELECT symbol, epoch_s, list(close) OVER (PARTITION BY symbol ORDER BY epoch_s ROWS UNBOUNDED PRECEDING) AS c FROM bars) SELECT symbol, epoch_s, {_EMA(21)} AS ema21 FROM wins",
    "ind3_rsi": f"{_WINS}, ch AS (SELECT symbol, epoch_s, len(c) AS n, list_transform(range(2, len(c) + 1), lambda i: c[i] - c[i - 1]) AS d FROM wins), g AS (SELECT *, {_WILDER('list_transform(d, lambda x: greatest(x, 0.0))')} AS up, {_WILDER('list_transform(d, lambda x: greatest(-x, 0.0))')} AS dn FROM ch WHERE n > 14) SELECT symbol, epoch_s, CASE WHEN n > 14 THEN CASE WHEN dn = 0 THEN 100.0 ELSE round(100 - 100 / (1 + up / dn), 2) END END AS rsi FROM ch LEFT JOIN (SELECT symbol, epoch_s, up, dn FROM g) USING (symbol, epoch_s)",
    "ind4_macd": f"{_MACD} SELECT b.symbol, b.epoch_s, round(line, 4) AS macd, round(g, 4) AS signal, round(line - round(g, 4), 4) AS hist FROM bars b LEFT JOIN (SELECT * FROM folded WHERE i = n) f ON f.symbol = b.symbol AND f.epoch_s = b.epoch_s",
    "ind5_atr": f"{_WINS}, tr AS (SELECT symbol, epoch_s, len(b) AS n, list_transform(range(1, len(b) + 1), lambda i: CASE WHEN i = 1 THEN b[1].h - b[1].l ELSE greatest(b[i].h - b[i].l, abs(b[i].h - b[i - 1].c), abs(b[i].l - b[i - 1].c)) END) AS t FROM wins) SELECT symbol, epoch_s, CASE WHEN n > 14 THEN round({_WILDER('t')}, 4) END AS atr FROM tr",
    "ind6_vwap": f"{_B} SELECT symbol, epoch_s, round(sum((high + low + close) / 3 * tick_volume) OVER w / sum(tick_volume) OVER w, 9) AS vwap FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY epoch_s ROWS 120 PRECEDING)",
    "ind7_pivots": f"{_B}, n AS (SELECT *, count(*) OVER p AS np, count(*) OVER q AS nq, max(high) OVER p AS hp, max(high) OVER q AS hq, min(low) OVER p AS lp, min(low) OVER q AS lq FROM bars WINDOW p AS (PARTITION BY symbol ORDER BY epoch_s ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY symbol ORDER BY epoch_s ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) SELECT symbol, epoch_s, high, low, hp < high AND hq <= high AS pivot_high, lp > low AND lq >= low AS pivot_low FROM n WHERE np = 2 AND nq = 2 AND ((hp < high AND hq <= high) OR (lp > low AND lq >= low))",
    "ind8_structure": f"""{_B}, w AS (SELECT symbol, epoch_s, list(high) OVER v AS h, list(low) OVER v AS l, list(close) OVER v AS c FROM bars WINDOW v AS (PARTITION BY symbol ORDER BY epoch_s ROWS 59 PRECEDING)),
 p AS (SELECT *, len(c) AS n, (list_max(h) + list_min(l)) / 2 AS mid, list_filter(range(3, len(h) - 1), lambda i: h[i] > h[i - 1] AND h[i] > h[i - 2] AND h[i] >= h[i + 1] AND h[i] >= h[i + 2]) AS a, list_filter(range(3, len(l) - 1), lambda i: l[i] < l[i - 1] AND l[i] < l[i - 2] AND l[i] <= l[i + 1] AND l[i] <= l[i + 2]) AS b FROM w),
 m AS (SELECT *, list_avg(c[1 : n // 2]) AS early, list_avg(c[n // 2 + 1 : n]) AS late FROM p)
 SELECT symbol, epoch_s, CASE WHEN n < 15 OR (mid > 0 AND (list_max(h) - list_min(l)) / mid < 0.0015) THEN 'RANGE' WHEN len(a) < 2 OR len(b) < 2 THEN CASE WHEN late > early * 1.002 THEN 'BULLISH' WHEN late < early * 0.998 THEN 'BEARISH' ELSE 'RANGE' END
 WHEN h[a[-1]] > h[a[-2]] AND l[b[-1]] > l[b[-2]] THEN 'BULLISH' WHEN h[a[-1]] < h[a[-2]] AND l[b[-1]] < l[b[-2]] THEN 'BEARISH' ELSE 'RANGE' END AS structure FROM m""",
    "sig6_context": f"{_BP} SELECT b.symbol, b.epoch_s, b.close, p.close AS close5 FROM bars b ASOF LEFT JOIN (SELECT symbol, epoch_s + {P - H} AS known_s, close FROM pbars) p ON b.symbol = p.symbol AND b.epoch_s >= p.known_s",
    "cls3_volatility": f"{_B}, r AS (SELECT symbol, epoch_s, round(high - low, 2) AS v FROM bars), w AS (SELECT *, list(v) OVER (PARTITION BY symbol ORDER BY epoch_s ROWS 120 PRECEDING) AS l FROM r), p AS (SELECT *, len(list_filter(l, lambda a: a <= v)) / len(l) AS rank FROM w) SELECT symbol, epoch_s, CASE WHEN len(l) < 5 THEN CASE WHEN v < 1.0 THEN 'Q1' WHEN v < 1.5 THEN 'Q2' WHEN v < 2.0 THEN 'Q3' WHEN v < 2.8 THEN 'Q4' ELSE 'Q5' END WHEN rank <= 0.2 THEN 'Q1' WHEN rank <= 0.4 THEN 'Q2' WHEN rank <= 0.6 THEN 'Q3' WHEN rank <= 0.8 THEN 'Q4' ELSE 'Q5' END AS quintile FROM p",
    "cls5_impulse": f"{_IMPULSE} SELECT symbol, direction, state, count(*) AS n FROM told GROUP BY 1, 2, 3",
    "ent1_immediate": f"{_SIMPLE} SELECT symbol, signal_time, direction, 'ENTERED_IMMEDIATELY' AS status, t1 AS entry_time, round(g * (round(o1, 2) + 0.3), 2) AS entry_price FROM m",
    "ent2_retrace": _sql_entry(3, [("l# <= round(ref - atr, 2)", None), ("l# <= round(ref - round(atr * 0.25::DOUBLE, 2), 2)", "least(round(ref - round(atr * 0.25::DOUBLE, 2), 2), o#)")], True),
    "ent2_retrace_causal": _sql_entry(3, [("o# <= round(ref - atr, 2)", None), ("l# <= round(ref - round(atr * 0.25::DOUBLE, 2), 2)", "least(round(ref - round(atr * 0.25::DOUBLE, 2), 2), o#)")], True),
    "ent3_reversion": _sql_entry(5, [("l# <= ref - atr * 1.2::DOUBLE", None), ("l# <= ema", "least(ema, o#)")], True),
    "ent4_momentum": f"{_SIMPLE} SELECT symbol, signal_time, direction, CASE WHEN t2 IS NULL THEN 'WAITING' WHEN c1 > o1 AND h1 > top THEN 'ENTERED_AFTER_DELAY' ELSE 'INVALIDATED' END AS status, CASE WHEN t2 IS NOT NULL AND c1 > o1 AND h1 > top THEN t2 END AS entry_time, CASE WHEN t2 IS NOT NULL AND c1 > o1 AND h1 > top THEN round(g * (round(o2, 2) + 0.3), 2) END AS entry_price FROM m",
    "ent5_breakout": _sql_entry(2, [("l# < bottom", None), ("h# >= round(top + round(atr * 0.2::DOUBLE, 2), 2)", "greatest(round(top + round(atr * 0.2::DOUBLE, 2), 2), o#)")], False),
    "ent6_hybrid": _sql_entry(3, [("l# <= round(ref - atr * 0.9::DOUBLE, 2)", None), ("l# <= round(ref - round(atr * 0.2::DOUBLE, 2), 2)", "least(round(ref - round(atr * 0.2::DOUBLE, 2), 2), o#)"), ("h# >= round(top + round(atr * 0.2::DOUBLE, 2), 2)", "greatest(round(top + round(atr * 0.2::DOUBLE, 2), 2), o#)")], False),
    "ent7_tight": _sql_entry(2, [("l# <= round(ref - atr * 0.75::DOUBLE, 2)", None), ("l# <= round(ref - round(atr * 0.15::DOUBLE, 2), 2)", "least(round(ref - round(atr * 0.15::DOUBLE, 2), 2), o#)")], False),
    "for1_excursions": f"{_B}, pos AS (SELECT symbol, epoch_s AS entry_time, epoch_s + {H} * (1 + (epoch_s // {H}) % 24) AS exit_time, (epoch_s // {H}) % 2 = 0 AS long_, open AS entry_price, symbol || '|' || epoch_s AS trade_id FROM bars), j AS (SELECT p.symbol, p.trade_id, b.epoch_s, greatest(0, CASE WHEN long_ THEN b.high - entry_price ELSE entry_price - b.low END) AS fav, greatest(0, CASE WHEN long_ THEN entry_price - b.low ELSE b.high - entry_price END) AS adv FROM pos p JOIN bars b ON b.symbol = p.symbol AND b.epoch_s BETWEEN p.entry_time AND p.exit_time) SELECT symbol, trade_id, count(*) AS bars, round(max(fav), 6) AS mfe, round(max(adv), 6) AS mae, round(max(fav) / 40, 6) AS mfe_r, round(max(adv) / 40, 6) AS mae_r, min(epoch_s) FILTER (adv >= 40) AS stop_s FROM j GROUP BY 1, 2",
    "aud1_same_bar": f"""{_B}, t AS (SELECT *, (epoch_s // {H}) % 2 = 0 AS long_, CASE WHEN (epoch_s // {H}) % 2 = 0 THEN high >= round(open + 10, 2) ELSE low <= round(open - 10, 2) END AS one, CASE WHEN (epoch_s // {H}) % 2 = 0 THEN low <= round(open - 10, 2) ELSE high >= round(open + 10, 2) END AS stop FROM bars)
 SELECT symbol, CASE WHEN long_ THEN 'LONG' ELSE 'SHORT' END AS direction, count(*) AS trades, count(*) FILTER (one OR stop) AS same_bar, count(*) FILTER (stop AND NOT one) AS same_bar_stops, count(*) FILTER (one) AS same_bar_targets, count(*) FILTER (one AND stop) AS doubtful,
 sum(CASE WHEN one THEN 1 WHEN stop THEN -1 ELSE 0 END)::DOUBLE AS total_r, sum(CASE WHEN stop THEN -1 WHEN one THEN 1 ELSE 0 END)::DOUBLE AS careful_total_r, -2 * count(*) FILTER (one AND stop)::DOUBLE AS delta_r, round(count(*) FILTER (one OR stop) * 100 / count(*), 6) AS same_bar_share FROM t GROUP BY 1, 2""",
    "for13_groups": f"""{_FWD}, g AS (SELECT symbol, direction, CAST(round((mfe1 - mae1) * 2.5::DOUBLE) AS BIGINT) AS r_h, 1 + (epoch_s // {H}) % 6 AS m, mfe60 / 40 AS mfe_r, mae60 / 40 AS mae_r FROM f)
 SELECT symbol, direction, CASE WHEN r_h > 0 AND mae_r <= 0.5 THEN 'GROUP_A_CLEAN_WIN' WHEN r_h < 0 AND m <= 3 AND mfe_r >= 1 THEN 'GROUP_B_EARLY_REV' WHEN r_h < 0 AND mfe_r < 1 THEN 'GROUP_C_FAILURE' WHEN r_h > 0 THEN 'OTHER_WIN' ELSE 'OTHER_LOSS' END AS outcome, count(*) AS n, CAST(sum(r_h) AS BIGINT) AS r_h FROM g GROUP BY 1, 2, 3""",
    "for14_forward": f"{_FWD} SELECT * FROM f",
    "for16_labels": f"{_FWD} SELECT CASE WHEN mae1 / 80 >= 1 THEN CASE WHEN mfe5 / 80 >= 1 THEN 'EARLY_ADVERSE_THEN_RECOVERY' ELSE 'PURE_ADVERSE' END WHEN mfe5 / 80 >= 1 AND mae5 / 80 <= 0.3 THEN 'FAST_CONTINUATION' WHEN mae5 / 80 <= 0.4 AND mfe5 / 80 >= 0.8 THEN 'IMMEDIATE_FAVORABLE' WHEN mae5 / 80 BETWEEN 0.2 AND 0.6 AND mfe5 / 80 >= 0.6 THEN 'CONTROLLED_RETRACE' ELSE 'CHOP' END AS label, direction, count(*) AS n FROM f GROUP BY 1, 2",
}
