"""Small cases worked out by hand, and the operators SQL does not say against direct loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators import bars, entries, experiments, forensics, montecarlo, quality, replay, signals, stats, windows
from tidemark.plans.joins import as_of, interval

LEDGER = "trade_id long, direction string, entry_time long, exit_time long, seq long, strength int, r_h long, pnl long, holding_minutes long, result string, day long"


def ledger(spark, r_h, start=1_704_067_200, step=3600, pnl=None):
    rows = []
    for i, h in enumerate(r_h):
        t = start + i * step
        rows.append((i, "LONG" if i % 2 == 0 else "SHORT", t, t + 600, i, 7, h, h if pnl is None else pnl[i], 10, "TP1" if h > 0 else "STOP_LOSS", t // 86400))
    return spark.createDataFrame(rows, LEDGER)


def series(spark, closes, spread=0.5):
    return spark.createDataFrame([("G", 60 * i, c, c + spread, c - spread, c, 100) for i, c in enumerate(closes)], "symbol string, epoch_s long, open double, high double, low double, close double, tick_volume long")


def last(spark, closes, what):
    b = I.sliding(series(spark, closes), 121).withColumn("x", what)
    return [r.x for r in b.orderBy("epoch_s").collect()]


def closes():
    return F.transform("win", lambda b: b["close"])


def test_bars_of_ticks(spark):
    t = spark.createDataFrame([("G", 0, 1, 2000.50), ("G", 10, 2, 2002.0), ("G", 59, 3, 1999.0), ("G", 60, 4, 2001.0), ("G", 5, 5, 1998.0)], "symbol string, epoch_s long, seq long, price double")
    b = bars.aggregate(t, 60).orderBy("epoch_s").collect()
    assert (b[0].open, b[0].high, b[0].low, b[0].close) == (2000.5, 2002.0, 1998.0, 1998.0)
    assert b[1].tick_volume == 1


def test_averages(spark):
    assert last(spark, [float(x) for x in range(10, 20)], I.ema(closes(), 5))[:6] == [None] * 4 + [12.0, 13.0]
    assert last(spark, [float(x) for x in range(20)], I.rsi(closes()))[-1] == 100.0
    assert last(spark, [float(-x) for x in range(20)], I.rsi(closes()))[-1] == 0.0
    s = I.ema_series(series(spark, [float(x) for x in range(10, 20)]), 5).orderBy("epoch_s").collect()
    assert [r.ema5 for r in s][:6] == [None] * 4 + [12.0, 13.0]


def test_range_and_volume(spark):
    b = spark.createDataFrame([("G", i, 0.0, 10.0, 0.0, 5.0, 0) for i in range(30)], "symbol string, epoch_s long, open double, high double, low double, close double, tick_volume long")
    rows = I.sliding(b, 121).select("epoch_s", I.atr(F.col("win")).alias("a"), I.vwap(F.col("win")).alias("v")).orderBy("epoch_s").collect()
    assert rows[-1].a == 10.0 and rows[13].a is None and rows[-1].v is None
    v = spark.createDataFrame([("G", 0, 100.0, 100.0, 100.0, 100.0, 100), ("G", 1, 102.0, 102.0, 102.0, 102.0, 200)], b.schema)
    assert I.sliding(v, 121).select(I.vwap(F.col("win")).alias("v")).collect()[1].v == 101.33


def macd_loop(p):
    def ema(x, n):
        out = [None] * (n - 1) + [sum(x[:n]) / n]
        for v in x[n:]:
            out.append(v * 2 / (n + 1) + out[-1] * (1 - 2 / (n + 1)))
        return out

    if len(p) < 35:
        return None
    line = [round(a, 4) - round(b, 4) for a, b in zip(ema(p, 12), ema(p, 26), strict=True) if b is not None]
    return line[-1], ema(line, 9)[-1]


def test_macd_equals_a_loop(spark):
    rng = random.Random(1)
    p = [round(2000 + 10 * rng.random(), 2) for _ in range(60)]
    got = last(spark, p, I.macd(closes()))
    for i in range(60):
        want = macd_loop(p[: i + 1])
        assert (got[i] is None) == (want is None)
        if want:
            assert got[i].macd == pytest.approx(want[0], abs=2e-4) and got[i].signal == pytest.approx(want[1], abs=2e-4)


def pivots_loop(v, k=2):
    return [v[i] for i in range(k, len(v) - k) if all(v[i] > v[i - j] and v[i] >= v[i + j] for j in range(1, k + 1))]


def levels_loop(points, tol):
    out = []
    for p in points:
        for c in out:
            if abs(c[0] - p) <= tol:
                c[1] += 1
                c[0] = round((c[0] * (c[1] - 1) + p) / c[1], 2)
                break
        else:
            out.append([round(p, 2), 1])
    return out


def test_pivots_and_levels_equal_loops(spark):
    rng = random.Random(4)
    p = [float(rng.randrange(100, 140)) for _ in range(80)]
    w = F.col("win")
    b = I.sliding(series(spark, p), 121).select("epoch_s", I.pivot_prices(w, "high").alias("h"), I.pivot_prices(w, "low").alias("l"))
    b = b.withColumn("c", I.levels(F.col("h"), F.col("l"), F.lit(120.0), F.lit(5.0))).orderBy("epoch_s").collect()
    for i, r in enumerate(b):
        hi, lo = pivots_loop([x + 0.5 for x in p[: i + 1]]), [-x for x in pivots_loop([0.5 - x for x in p[: i + 1]])]
        assert (list(r.h), list(r.l)) == (hi, lo)
        assert [[x.price, x.touches] for x in r.c] == levels_loop(hi[-15:] + lo[-15:], 2.0)


def test_cleaning(spark):
    raw = spark.createDataFrame([("G", 120, 1.0, 2.0, 1.0, 2.0, 1), ("G", 60, 1.0, 2.0, 1.0, 1.5, 2), ("G", 60, 1.0, 2.0, 1.0, 1.7, 3), ("G", 180, -1.0, 2.0, 1.0, 1.0, 4)], "symbol string, epoch_s long, open double, high double, low double, close double, seq long")
    r = quality.cleaning_report(raw, ["symbol"]).first()
    assert (r.kept, r.invalid, r.duplicates, r.inversions) == (2, 1, 1, 1)
    assert [(x.epoch_s, x.close) for x in quality.clean(raw, ["symbol"]).orderBy("epoch_s").collect()] == [(60, 1.5), (120, 2.0)]
    both = quality.upsert(raw.where("seq < 3").drop("seq"), raw.where("seq = 3").drop("seq"), ["symbol"])
    assert sorted(x.close for x in both.collect()) == [1.7, 2.0]


def test_gaps_and_coverage(spark):
    friday, day = 1_704_486_600, 86400  # Friday 20:30 UTC
    b = spark.createDataFrame([("A", friday), ("A", friday + 2 * day), ("B", friday - 2 * day), ("B", friday - 2 * day + 5400)], "symbol string, epoch_s long")
    assert {r.symbol: r.kind for r in quality.gaps(b, ["symbol"]).collect()} == {"A": "expected", "B": "unexpected"}
    c = spark.createDataFrame([(str(n), x) for n in (10, 200, 355, 366) for x in (0, n * day)], "symbol string, epoch_s long")
    assert {r.symbol: r.status for r in quality.coverage(c, ["symbol"]).collect()} == {"10": "INSUFFICIENT", "200": "LIMITED", "355": "12-MONTH", "366": "12-MONTH"}


def test_headline_and_expectancy(spark):
    h = stats.headline(ledger(spark, [200, 150, -100, 50, -100]), []).first()
    assert (h.wins, h.win_rate, h.total_r, h.average_r, h.profit_factor) == (3, 60.0, 2.0, 0.4, 2.0)
    assert stats.expectancy(ledger(spark, [100, 150, -100, -100]), []).first().expectancy == pytest.approx(0.125)
    assert stats.headline(ledger(spark, [100, 50]), [], None).first().profit_factor is None


def test_drawdown_and_depletion(spark):
    d = stats.drawdown_analysis(ledger(spark, [200, -300, 500]), []).first()
    assert d.max_drawdown == 300 and round(d.max_drawdown_pct, 2) == 2.94
    s = stats.slice_summary(ledger(spark, [-100] * 150), []).first()
    assert (s.max_drawdown, s.max_drawdown_pct, s.depletion_index, s.max_losses, s.solvent) == (15000, 150.0, 99, 150, False)


def test_streaks_across_days(spark):
    r = stats.streaks(ledger(spark, [100] * 30 + [0] + [100] * 5 + [-100] * 26), []).first()
    assert (r.max_wins, r.max_losses) == (30, 26)


def test_percentiles_by_floor_index(spark):
    d = stats.distribution(spark.createDataFrame([(float(x),) for x in range(1, 11)], "v double"), [], "v").first()
    assert (d.mean, d.median, d.p25, d.p75) == (5.5, 5.5, 3.0, 7.0)


def test_concentration(spark):
    t = ledger(spark, [300, 200]).unionByName(ledger(spark, [100], start=1_706_745_600))
    c = stats.concentration(t).first()
    assert c.total_r == 6.0 and c.top1_pct > 80


def test_windows():
    day = 86400
    assert windows.slices(0, 10 * day) == [(1, 0, 7 * day, 7 * day, 10 * day)]
    w = windows.slices(0, 200 * day)
    assert [x[0] for x in w] == list(range(1, len(w) + 1)) and w[0] == (1, 0, 90 * day, 90 * day, 120 * day) and w[-1][4] == 200 * day
    assert windows.slices(0, 100) == []
    with pytest.raises(ValueError):
        experiments.guard(5, 20, 10)


def test_joins(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1), ("a", 1)], "k string, t long")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y")], "k string, u long, v string")
    assert sorted((r.k, r.t, r.v) for r in as_of(left, right, ["k"], "t", "u", ["v"]).collect()) == [("a", 1, None), ("a", 5, "x"), ("a", 10, "y"), ("b", 1, None)]
    spans = spark.createDataFrame([("a", 0, 10), ("a", 5, 4), ("b", 0, 100)], "k string, s long, e long")
    assert sorted((r.k, r.s, r.t) for r in interval(left, spans, ["k"], "t", "s", "e", 3).collect()) == [("a", 0, 1), ("a", 0, 5), ("a", 0, 10), ("b", 0, 1)]


SIGNAL = ("G", 0, "LONG", 8, 2.0, "BULLISH", 2004.0, 2005.0, 1995.0, 2000.0)
SIGNALS = "symbol string, signal_time long, direction string, strength int, atr double, trend string, signal_close double, signal_high double, signal_low double, ema21 double"


def entered(spark, after, policy, direction="LONG", causal=False):
    rows = [("G", 0, 2000.0, 2005.0, 1995.0, 2004.0)] + [("G", 60 * (i + 1), *map(float, b)) for i, b in enumerate(after)]
    b = spark.createDataFrame(rows, "symbol string, epoch_s long, open double, high double, low double, close double")
    s = spark.createDataFrame([SIGNAL[:2] + (direction,) + SIGNAL[3:]], SIGNALS)
    r = entries.evaluate(entries.with_path(s, b, policy.wait), policy, causal).first()
    return r.status, r.entry_time, r.entry_price


def test_entries(spark):
    quiet = (2004.5, 2004.6, 2004.4, 2004.5)
    assert entered(spark, [quiet], entries.immediate()) == ("ENTERED_IMMEDIATELY", 60, 2004.8)
    assert entered(spark, [quiet, (2004.2, 2004.3, 2003.4, 2003.8)], entries.retrace()) == ("ENTERED_AFTER_DELAY", 120, 2003.8)
    assert entered(spark, [(2004.0, 2004.1, 2001.5, 2002.0)], entries.retrace())[0] == "INVALIDATED"
    assert entered(spark, [(2004.0, 2004.1, 2001.5, 2002.0)], entries.retrace(), causal=True) == ("ENTERED_AFTER_DELAY", 60, 2003.8)
    assert entered(spark, [quiet] * 3, entries.retrace())[0] == "TIMED_OUT"
    assert entered(spark, [quiet], entries.retrace())[0] == "WAITING"
    assert entered(spark, [(2004.0, 2004.2, 2003.5, 2004.0)], entries.hybrid()) == ("ENTERED_AFTER_DELAY", 60, 2003.9)
    assert entered(spark, [(2004.0, 2005.5, 2003.9, 2005.4)], entries.hybrid()) == ("ENTERED_AFTER_DELAY", 60, 2005.7)
    assert entered(spark, [(2003.9, 2004.0, 2003.6, 2003.7)], entries.tight())[2] == 2004.0
    assert entered(spark, [(2004.1, 2004.4, 2004.0, 2004.3)], entries.tight(), "SHORT")[2] == 2004.0


def direct_replay(b, sigs, c):
    """One position at a time, bar by bar."""
    out, trade, pending = [], None, None
    r2 = lambda x: round(x + (1e-9 if x > 0 else -1e-9), 2)
    for i, (t, o, h, lo, cl) in enumerate(b):
        if pending and not trade:
            d, atr, st = pending
            e = r2(o + d * (c.spread + c.slippage_atr * atr))
            dist = max(c.least_stop, r2(atr * c.stop_atr))
            trade, pending = {"d": d, "e": e, "dist": dist, "stop": d * e - dist, "one": d * e + r2(atr * c.target1_atr), "two": d * e + r2(atr * c.target2_atr), "t": t, "mfe": 0.0, "st": st, "atr": atr}, None
        if trade:
            d = trade["d"]
            hi, low = (h, lo) if d > 0 else (-lo, -h)
            trade["mfe"] = max(trade["mfe"], hi - d * trade["e"])
            r = trade["mfe"] / trade["dist"]
            if c.breakeven_r is not None and r >= c.breakeven_r:
                trade["stop"] = max(trade["stop"], d * trade["e"])
            if c.trail_r is not None and r >= c.trail_r:
                trade["stop"] = max(trade["stop"], r2(hi - c.trail_atr * trade["atr"]))
            eps = 1e-7
            sl, one, two = low <= trade["stop"] + eps, hi >= trade["one"] - eps, hi >= trade["two"] - eps
            mins = (t - trade["t"]) / 60
            held = (t - trade["st"]) / 60 if c.from_signal else mins
            x = None
            if sl and one:
                x = trade["stop"] if c.stop_first else trade["one"]
            elif sl:
                x = trade["stop"]
            elif two:
                x = trade["two"]
            elif one:
                x = trade["one"]
            elif (c.idle_minutes is not None and mins >= c.idle_minutes and r < c.idle_r) or held >= c.max_minutes:
                x = d * cl
            if x is not None:
                out.append((trade["st"], trade["t"], t, round((x - d * trade["e"]) / trade["dist"], 1)))
                trade = None
        if not trade and not pending and i < len(b) - 1 and t in sigs:
            pending = (*sigs[t], t)
    return out


@pytest.mark.parametrize("changes", [{}, {"breakeven_r": 0.5, "trail_r": 0.8, "trail_atr": 0.5}, {"stop_first": False, "idle_minutes": 5, "idle_r": 0.3}, {"max_minutes": 7}, {"max_minutes": 7, "from_signal": True}, {"slippage_atr": 0.1}])
def test_replay_equals_a_direct_loop(spark, changes):
    rng = random.Random(str(changes))
    rows, sigs, t, p = [], [], 0, 200_000
    for _ in range(600):
        t += 60 * rng.choice([1] * 9 + [30])
        o = p
        p += rng.randrange(-120, 121)
        rows.append((t, o / 100, (max(o, p) + rng.randrange(0, 60)) / 100, (min(o, p) - rng.randrange(0, 60)) / 100, p / 100))
        if rng.random() < 0.2:
            sigs.append((t, rng.choice([1, -1]), rng.randrange(100, 300) / 100))
    c = replay.Config(**changes)
    b = spark.createDataFrame([("G", *r) for r in rows], "symbol string, epoch_s long, open double, high double, low double, close double")
    at = {r[0]: r for r in rows}
    s = spark.createDataFrame([("G", t, "LONG" if d > 0 else "SHORT", 8, a, "BULLISH", at[t][4], at[t][2], at[t][3], None) for t, d, a in sigs], SIGNALS)
    want = direct_replay(rows, {t: (d, a) for t, d, a in sigs}, c)
    got = [(r.signal_time, r.entry_time, r.exit_time, r.r_multiple) for r in replay.replay(s, b, replay.frame(spark, [c]), 60).orderBy("entry_time").collect()]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) <= 0.11 for g, w in zip(got, want, strict=True))


def test_doubtful_trades_of_one_bar(spark):
    b = series(spark, [100.0, 100.0, 100.0], spread=5.0)
    schema = "symbol string, entry_time long, exit_time long, direction string, entry_price double, stop_loss double, target double, result string, r_h long"
    t = [("G", 0, 0, "LONG", 100.0, 96.0, 104.0, "TP1", 100), ("G", 60, 60, "SHORT", 100.0, 104.0, 90.0, "STOP_LOSS", -100), ("G", 60, 120, "LONG", 100.0, 96.0, 104.0, "TP1", 100), ("G", 999, 999, "LONG", 100.0, 96.0, 104.0, "TP1", 100)]
    r = forensics.same_bar(spark.createDataFrame(t, schema), b, ["symbol"]).first()
    assert (r.trades, r.same_bar, r.same_bar_stops, r.same_bar_targets, r.doubtful) == (4, 3, 1, 2, 1)
    assert (r.total_r, r.careful_total_r, r.delta_r, r.same_bar_share) == (2.0, 0.0, -2.0, 75.0)


def test_parts_of_a_score(spark):
    schema = "direction string, close double, atr double, trend string, structure string, ema9 double, ema21 double, rsi double, macd struct<hist:double>, supports array<struct<price:double>>, resistances array<struct<price:double>>"
    rows = [
        ("LONG", 100.0, 2.0, "BULLISH", "BULLISH", 2.0, 1.0, 68.0, (0.1,), [(97.0,)], []),
        ("SHORT", 100.0, 2.0, "BEARISH", "RANGE", 1.0, 2.0, 32.0, (-0.1,), [(99.0,)], [(103.0,)]),
        ("LONG", 100.0, None, "RANGE", None, None, None, None, None, [], []),
        ("SHORT", 100.0, 1.0, "BULLISH", "BULLISH", 2.0, 101.0, 61.0, (0.1,), [(99.0,)], []),
    ]
    got = signals.components(spark.createDataFrame(rows, schema)).select("has_trend", "has_structure", "has_cross", "has_momentum", "has_strength", "has_level", "has_side").collect()
    assert [tuple(r) for r in got] == [(True,) * 6 + (True,), (True, False, True, True, True, True, False), (False,) * 6 + (True,), (False, False, True, False, False, False, True)]


def test_refresh_reads_what_is_missing(spark):
    d = 86400
    schema = "symbol string, epoch_s long, open double, high double, low double, close double, seq long"
    bar = lambda s, day, p: (s, day * d, p, p, p, p, day)
    held = spark.createDataFrame([bar("A", k, 1.0) for k in (10, 11, 13)], schema)
    source = spark.createDataFrame([bar(s, k, 2.0) for s in "AB" for k in range(30)], schema)
    got = quality.refresh(held, source, ["symbol"], 5 * d, 15 * d).collect()
    a = {r.epoch_s // d: r.close for r in got if r.symbol == "A"}
    assert a == {5: 2.0, 6: 2.0, 7: 2.0, 8: 2.0, 9: 2.0, 10: 2.0, 11: 1.0, 13: 1.0}  # what is read anew wins; the tail lacks no more than the slack, and day 12 is an inner gap
    assert {r.epoch_s // d for r in got if r.symbol == "B"} == set(range(5, 16))
    assert quality.refresh(held.limit(0), source, ["symbol"], 5 * d, 6 * d).count() == 4


def test_amounts_of_nothing_are_kept_where_they_may_be(spark):
    d = 86400
    schema = "symbol string, epoch_s long, open double, high double, low double, close double, seq long"
    source = spark.createDataFrame([("A", k * d, 1.0, 2.0, low, 1.0, k) for k, low in enumerate((0.5, 0.0, -0.25))], schema)
    held = source.where("seq = 1")
    assert [r.low for r in quality.refresh(held, source, ["symbol"], 0, 2 * d, 0, signed=True).orderBy("epoch_s").collect()] == [0.5, 0.0, -0.25]
    assert [r.low for r in quality.refresh(held, source, ["symbol"], 0, 2 * d, 0).collect()] == [0.5]


def test_signals_do_not_see_the_future(spark):
    rng = random.Random(8)
    p = [2000 + 3 * i / 10 + rng.random() * 4 for i in range(260)]
    t = series(spark, [round(x, 2) for x in p])
    five = bars.resample(t, 300)
    f = signals.score(signals.features(t, five, 60, 300), 5).where("epoch_s <= 12000").select("epoch_s", "type", "strength", "rsi", "trend")
    cut = t.where("epoch_s <= 12000")
    g = signals.score(signals.features(cut, bars.resample(t, 300).where("epoch_s + 300 <= 12060"), 60, 300), 5).select("epoch_s", "type", "strength", "rsi", "trend")
    assert sorted(map(tuple, f.collect())) == sorted(map(tuple, g.collect()))


def test_bootstrap_is_the_same_for_a_seed(spark):
    t = ledger(spark, [100, -100, 50, 200, -100, -50, 0, 100, -100, 150, -100, 50])
    a, b = (sorted(map(tuple, montecarlo.simulate(t, 50).repartition(n).collect())) for n in (1, 3))
    assert a == b and len(a) == 50
    assert montecarlo.simulate(t.limit(0), 50).count() == 0
    losing = montecarlo.simulate(ledger(spark, [-100] * 7), 5).collect()
    assert {(r.max_drawdown, r.ending_r, r.losing_streak) for r in losing} == {(700.0, -7.0, 7)}


def test_few_draws_of_a_simulation_are_searched_for(monkeypatch):
    searched, search = [], np.searchsorted
    monkeypatch.setattr(montecarlo.np, "searchsorted", lambda a, v, side: searched.append(len(v)) or search(a, v, side))
    monkeypatch.setattr(montecarlo, "CHUNK", 1000)
    for n, values in ((200_000, np.arange(-60, 41)), (200_001, np.array([-7])), (3, np.array([-2, 5])), (150_000, np.arange(-40_000, 39_999, 3))):
        upto = np.unique(np.linspace(0, n, len(values) + 1).astype(np.int64)[1:])
        values = values[: len(upto)]
        table = montecarlo.lookup(values, upto)
        searched.clear()
        got = montecarlo.simulation(3, 42, values, upto, table)
        assert sum(searched) < 0.1 * n + 1  # before, all
        r = values[search(upto, np.random.default_rng([42, 3]).integers(0, n, n), "right")]
        equity = np.cumsum(r)
        runs = "".join("x" if x < 0 else " " for x in r).split()
        assert got == (3, float((np.maximum.accumulate(np.maximum(equity, 0)) - equity).max()), int(r.sum()) / 100, max(map(len, runs), default=0))



def test_tags_and_times(spark):
    context = "array(named_struct('to', 0.4D, 'mfe', 0.1D, 'later', 1.5D), named_struct('to', 0.4D, 'mfe', 0.9D, 'later', 0.2D), named_struct('to', CAST(NULL AS DOUBLE), 'mfe', 0.3D, 'later', 0.2D))[trade_id % 3]"
    t = ledger(spark, [-200, 100, -100, -50]).withColumn("c", F.expr(context)).withColumns({"trend": F.expr("array('RANGE', 'BULLISH', 'BULLISH', 'BEARISH')[trade_id]"), "rsi": F.expr("array(70D, 50D, NULL, 30D)[trade_id]"), "to_resistance": F.col("c.to"), "to_support": F.col("c.to"), "to_ema50": F.lit(None).cast("double"), "mfe": F.col("c.mfe"), "mfe_r": F.col("c.mfe"), "later_r": F.col("c.later")})
    tags = {r.trade_id: r.tags for r in forensics.failure_tags(t).collect()}
    assert tags == {0: ["SL_THEN_TP_REVERSAL", "RESISTANCE_FAILURE", "RANGE_NOISE", "MOMENTUM_EXHAUSTION"], 2: ["UNKNOWN"], 3: ["SL_THEN_TP_REVERSAL", "SUPPORT_FAILURE", "MOMENTUM_EXHAUSTION"]}
    quick = forensics.failure_tags(t.withColumns({"holding_minutes": F.lit(2), "mfe": F.lit(0.5)})).where("trade_id = 2").first().tags
    assert quick == ["HIGH_SPREAD_EROSION"]
    s = spark.createDataFrame([("1704067200",), ("1704067200000",), ("2024-01-01T00:00:00Z",), ("2024-01-01 junk",), ("x",)], "v string")
    assert [r[0] for r in s.select(replay.parse_time(F.col("v"))).collect()] == [1704067200] * 4 + [None]


def test_flags_follow_their_thresholds(spark):
    good = {"history_days": 400, "complete": True, "windows": 8, "trades": 100, "total_r": 5.0, "oos_trades": 60, "oos_total_r": 1.0, "oos_average_r": 0.1, "low_spread_average_r": 0.1, "high_spread_average_r": 0.0, "low_spread_total_r": 5.0, "high_spread_total_r": 1.0}
    good |= {"low_threshold_win_rate": 50.0, "high_threshold_win_rate": 60.0, "low_threshold_trades": 100, "high_threshold_trades": 40, "min_exit_total_r": 1.0, "max_exit_total_r": 9.0, "top1_pct": 40.0, "max_drawdown_pct": 14.0}
    good |= {"long_trades": 50, "short_trades": 50, "long_win_rate": 50.0, "short_win_rate": 60.0, "long_total_r": 1.0, "short_total_r": 2.0}
    cases = {
        "history_days": {179: "INSUFFICIENT_HISTORY", 180: "LIMITED_HISTORY", 349: "LIMITED_HISTORY", 350: None},
        "complete": {False: "INCOMPLETE_DATASET"},
        "windows": {0: "INSUFFICIENT_OOS_WINDOWS", 5: "INSUFFICIENT_OOS_WINDOWS", 6: None},
        "trades": {29: "LOW_SAMPLE_SIZE", 30: None},
        "oos_trades": {29: "LOW_OOS_SAMPLE"},
        "oos_average_r": {-0.1: "NEGATIVE_OOS_EXPECTANCY"},
        "high_spread_total_r": {-1.0: "HIGH_SPREAD_SENSITIVITY"},
        "high_threshold_trades": {9: "HIGH_THRESHOLD_SENSITIVITY"},
        "max_exit_total_r": {12.0: "HIGH_EXIT_SENSITIVITY", 11.0: None},
        "top1_pct": {51.0: "HIGH_PERIOD_CONCENTRATION", 50.0: None},
        "short_total_r": {-2.0: "DIRECTIONAL_ASYMMETRY"},
        "max_drawdown_pct": {15.0: "HIGH_DRAWDOWN"},
    }
    rows, want = [good | {"k": "good"}], {"good": []}
    for name, values in cases.items():
        for v, flag in values.items():
            rows.append(good | {name: v, "k": f"{name}={v}"})
            want[f"{name}={v}"] = [flag] if flag else []
    facts = spark.createDataFrame(rows, "k string, " + ", ".join(f"{n} {'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'double'}" for n, v in good.items()))
    got = {k: [] for k in want}
    for r in experiments.flags(facts, ["k"]).collect():
        got[r.k].append(r.flag)
    assert got == want


def test_experiments_change_one_thing_each():
    e = {x.id: x for x in experiments.EXPERIMENTS}
    assert len(e) == 14 and all(bool(x.changes) + bool(x.filter) + bool(x.without) == 1 for x in e.values())
    assert e["EXP-005"].changes == {"stop_atr": 1.5, "target1_atr": 2.0, "target2_atr": 2.0} and e["EXP-006"].changes == {"threshold": 8}
    assert e["ABL-001"].without == ("strength_zone", "strength_extreme") and e["ABL-002"].without == ("momentum",)
