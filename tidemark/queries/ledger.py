"""Trade statistics over the two ledgers: ST and the aggregates of FOR that need trades alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import classify, forensics, stats, windows
from tidemark.sources import adapters as A

_T, _L = f"WITH {A.SQL_TRADES}", f"WITH {A.SQL_LONG}"
FIGURES = ("trades", "wins", "win_rate", "total_r", "average_r", "profit_factor")


def st1_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.headline(A.trades(spark, sf_dir), ["symbol"])


def st1_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline over the largest table, where order does not matter."""
    li = A.table(spark, sf_dir, "lineitem").select((F.round(F.col("l_extendedprice") * 100).cast("long") % 401 - 200).alias("r_h"), F.col("l_returnflag").alias("symbol"), (1 + F.col("l_orderkey") % 60).alias("holding_minutes"), F.when(F.col("l_linenumber") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"))
    li = li.withColumns({"pnl": F.col("r_h"), "result": F.when(F.col("r_h") == 0, "EXPIRED").otherwise("TP1")})
    return stats.headline(li, ["symbol"])


def st2_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.equity_curve(A.trades(spark, sf_dir), []).select("trade_id", "exit_time", "equity", "drawdown", "drawdown_pct")


def st2_drawdown_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.drawdown(A.long_trades(spark, sf_dir), ["strength"])


def st3_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.streaks(A.trades(spark, sf_dir), ["symbol"])


def st4_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_group(A.trades(spark, sf_dir).where("strength BETWEEN 7 AND 10"), F.col("strength"), "strength")


def st5_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_direction(A.trades(spark, sf_dir))


def st6_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_group(A.trades(spark, sf_dir), classify.session("entry_time"), "session")


def st7_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.trades(spark, sf_dir).withColumn("regime", F.when(F.col("trade_id") % 3 == 0, "BULLISH").when(F.col("trade_id") % 3 == 1, "BEARISH"))
    return stats.by_group(t, F.coalesce("regime", F.lit("UNCLASSIFIED")), "regime")


def st8_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.slice_summary(A.trades(spark, sf_dir), ["symbol"], 300)


def st9_expectancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.expectancy(A.trades(spark, sf_dir), ["symbol"])


def st10_drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.drawdown_analysis(A.trades(spark, sf_dir), ["symbol"])


def st11_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.monthly(A.long_trades(spark, sf_dir))


def st12_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.concentration(A.long_trades(spark, sf_dir))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.long_trades(spark, sf_dir)
    return windows.evaluate(t, windows.frame(spark, windows.slices(788918400, 996624000)))


def val1_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.frame(spark, windows.slices(788918400, 996624000))


def val3_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)


def st13_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.consistency(_windows(spark, sf_dir).withColumn("label", F.concat(F.lit("W"), "window_index")))


def st14_oos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.out_of_sample(_windows(spark, sf_dir))


def st15_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(A.trades(spark, sf_dir), ["direction"], "r")


def st16_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.percentiles(A.trades(spark, sf_dir), ["symbol"], "r")


def st17_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bucket_metrics(A.trades(spark, sf_dir), classify.session("entry_time"), "session")


def st18_slice_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.slice_metrics(A.trades(spark, sf_dir), ["symbol"])


def st19_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.trades(spark, sf_dir)
    return stats.delta(stats.headline(t, ["symbol"]), stats.headline(t.where("strength >= 8"), ["symbol"]), ["symbol"])


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    state = F.when(F.col("event_type") == "click", "FILLED").when(F.col("event_type") == "view", "TIMED_OUT").when(F.col("event_type") == "error", "INVALIDATED").when(k % 2 == 0, "BLOCKED").otherwise("CLOSED")
    return e.select("event_id", "ts", A.epoch("ts").alias("epoch_s"), F.col("user_id"), state.alias("state"), k.alias("k")).withColumn("r_h", F.when(F.col("state") == "CLOSED", F.col("k") * 4 - 200))


def st20_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.journal_metrics(_journal(spark, sf_dir).withColumn("day", F.floor(F.col("epoch_s") / 86400)), ["day"])


def str10_journal_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _journal(spark, sf_dir).where("epoch_s >= 1704844800")
    return j.orderBy(F.desc("event_id")).limit(50).select("event_id", "state", "k")


def st21_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlations(A.trades(spark, sf_dir), ["r_h", "holding_minutes", "strength", "entry_time"])


def for5_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forensics.category_counts(forensics.failure_tags(A.with_context(A.trades(spark, sf_dir))))


def for3_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = forensics.stopped_then(A.with_context(A.trades(spark, sf_dir)))
    return t.groupBy("symbol", "direction").agg(F.count_if(F.col("result") == "STOP_LOSS").alias("stopped"), F.count_if("stopped_then_1r").alias("then_1r"), F.count_if("stopped_then_2r").alias("then_2r"))


def for4_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = forensics.failure_tags(A.with_context(A.trades(spark, sf_dir)))
    return tagged.select("trade_id", "r_h", F.array_join("tags", "|").alias("labels"))


def for6_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forensics.score_direction(A.trades(spark, sf_dir))


def for7_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.with_context(A.trades(spark, sf_dir)).withColumn("session", classify.session("entry_time"))
    return forensics.contrast(t, {name: c() for name, c in forensics.CONDITIONS.items()})


def for8_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.trades(spark, sf_dir).where("r_h <> 0").withColumn("outcome", F.when(F.col("r_h") > 0, "WIN").otherwise("LOSS"))
    return stats.distribution(t, ["outcome"], "holding_minutes")


def for9_holding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_group(A.trades(spark, sf_dir), forensics.holding_bucket("holding_minutes"), "bucket").where("bucket IS NOT NULL")


def for10_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.trades(spark, sf_dir).withColumn("session", classify.session("entry_time"))
    return forensics.losses_by(t, "session")


def for15_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forensics.dimensions(A.trades(spark, sf_dir).withColumn("session", classify.session("entry_time")), ["session", "strength", "direction"], 100)


def aud2_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forensics.overlapping(A.trades(spark, sf_dir), "symbol")


def exp5_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.trades(spark, sf_dir)
    other = t.where("strength >= 8").withColumn("r_h", F.when(F.col("trade_id") % 10 == 0, F.col("r_h") + 5).otherwise(F.col("r_h")))
    return forensics.reconcile(t, other).groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum("d_h").alias("d_h"))


QUERIES = {k: f for k, f in list(globals().items()) if k[:2] in ("st", "va", "fo", "au", "ex") and k[-1] != "_" and any(ch.isdigit() for ch in k.split("_")[0]) and callable(f)}

_W = lambda c: f"count(*) FILTER ({c})"
_PF = lambda no: f"CASE WHEN coalesce(-sum(pnl) FILTER (r_h < 0), 0) > 0 THEN round(coalesce(sum(pnl) FILTER (r_h > 0), 0)::DOUBLE / -sum(pnl) FILTER (r_h < 0), 6) WHEN coalesce(sum(pnl) FILTER (r_h > 0), 0) > 0 THEN {no} ELSE 0.0 END AS profit_factor"
_HEAD = lambda no="999.0": f"""count(*) AS trades, {_W("direction = 'LONG'")} AS long_trades, {_W('r_h > 0')} AS wins, {_W('r_h < 0')} AS losses, {_W("result = 'EXPIRED'")} AS expired, round({_W('r_h > 0')} * 100 / count(*), 6) AS win_rate, sum(r_h)::DOUBLE / 100 AS total_r, round(avg(r_h) / 100, 6) AS average_r, median(r_h) / 100 AS median_r,
 round(coalesce(avg(r_h) FILTER (r_h > 0), 0) / 100, 6) AS average_win_r, round(coalesce(avg(r_h) FILTER (r_h < 0), 0) / 100, 6) AS average_loss_r, max(r_h) / 100 AS largest_win_r, min(r_h) / 100 AS largest_loss_r, round(avg(holding_minutes), 6) AS average_holding, max(holding_minutes) AS max_holding, {_PF(no)}"""  # noqa: E731
_GROUP = f"count(*) AS trades, {_W('r_h > 0')} AS wins, round({_W('r_h > 0')} * 100 / count(*), 6) AS win_rate, sum(r_h)::DOUBLE / 100 AS total_r, round(avg(r_h) / 100, 6) AS average_r, {_PF('999.0')}"
_EQ = lambda by, cap=10000, src="trades": f"eq0 AS (SELECT *, {cap} + sum(pnl) OVER (PARTITION BY {by} ORDER BY entry_time, seq ROWS UNBOUNDED PRECEDING) AS equity FROM {src}), eq1 AS (SELECT *, greatest({cap}, max(equity) OVER (PARTITION BY {by} ORDER BY entry_time, seq ROWS UNBOUNDED PRECEDING)) AS peak FROM eq0), eq AS (SELECT *, CAST(peak - equity AS BIGINT) AS drawdown, CASE WHEN peak > 0 THEN round((peak - equity)::DOUBLE * 100 / peak, 6) WHEN peak - equity > 0 THEN 100.0 ELSE 0.0 END AS drawdown_pct FROM eq1)"
_RUN = lambda by, cond, name, src="trades": f"{name}_r AS (SELECT {by} AS by_, count(*) AS n FROM (SELECT *, sum(CASE WHEN {cond} THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY entry_time, seq ROWS UNBOUNDED PRECEDING) AS run FROM {src}) WHERE {cond} GROUP BY {by}, run), {name} AS (SELECT by_, max(n) AS longest, avg(n) AS mean FROM {name}_r GROUP BY 1)"
_SESSION = "CASE WHEN h < 8 THEN 'Asia' WHEN h < 13 THEN 'London' WHEN h < 16 THEN 'London/NY Overlap' WHEN h < 21 THEN 'New York' ELSE 'Off-Session' END"
_S = f"{_T}, sess AS (SELECT *, {_SESSION} AS session FROM (SELECT *, (entry_time // 3600) % 24 AS h FROM trades))"
_WIN = f"{_L}, w(window_index, train_start, train_end, val_start, val_end) AS (VALUES {', '.join(str(x) for x in windows.slices(788918400, 996624000))}), wt AS (SELECT w.window_index, w.val_start::BIGINT AS val_start, w.val_end::BIGINT AS val_end, t.* FROM w JOIN trades t ON t.entry_time >= w.val_start AND t.entry_time < w.val_end), {_EQ('window_index', src='wt')}, wf AS (SELECT window_index, val_start, val_end, {_GROUP}, max(drawdown) AS max_drawdown FROM eq GROUP BY 1, 2, 3)"
_JOURNAL = "WITH j AS (SELECT *, CASE WHEN state = 'CLOSED' THEN k * 4 - 200 END AS r_h, CASE WHEN state = 'CLOSED' THEN k * 4 - 200 END AS pnl FROM (SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS epoch_s, k, CASE WHEN event_type = 'click' THEN 'FILLED' WHEN event_type = 'view' THEN 'TIMED_OUT' WHEN event_type = 'error' THEN 'INVALIDATED' WHEN k % 2 = 0 THEN 'BLOCKED' ELSE 'CLOSED' END AS state FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)))"
_DIST = lambda v, by, src="trades": f"SELECT {by}, count(*) AS n, round(avg({v}), 6) AS mean, round(median({v}), 6) AS median, {', '.join(f'list_sort(list({v}))[CAST(floor({p} * (count(*) - 1)) AS INT) + 1] AS p{round(p * 100)}' for p in (0.1, 0.25, 0.75, 0.9, 0.95))} FROM {src} GROUP BY 1"

_TC = f"{_T}, {A.SQL_CONTEXT}"
_TAGGED = """tagged AS (SELECT trade_id, r_h, CASE WHEN len(l) = 0 THEN ['UNKNOWN'] ELSE l END AS tags FROM (SELECT trade_id, r_h, list_filter([
 CASE WHEN holding_minutes <= 3 AND mfe_r < 0.25 THEN 'EARLY_REVERSAL' END,
 CASE WHEN result = 'STOP_LOSS' AND later_r >= 1 THEN 'SL_THEN_TP_REVERSAL' END,
 CASE WHEN direction = 'LONG' AND to_resistance <= 0.5 THEN 'RESISTANCE_FAILURE' END,
 CASE WHEN direction = 'SHORT' AND to_support <= 0.5 THEN 'SUPPORT_FAILURE' END,
 CASE WHEN trend = CASE direction WHEN 'LONG' THEN 'BEARISH' ELSE 'BULLISH' END THEN 'TREND_MISMATCH' END,
 CASE WHEN trend = 'RANGE' OR regime = 'RANGE' THEN 'RANGE_NOISE' END,
 CASE WHEN (direction = 'LONG' AND rsi >= 70) OR (direction = 'SHORT' AND rsi <= 30) OR to_ema50 >= 2 THEN 'MOMENTUM_EXHAUSTION' END,
 CASE WHEN mfe >= 1.5::DOUBLE * 0.3::DOUBLE AND r_h < 0 THEN 'HIGH_SPREAD_EROSION' END], lambda x: x IS NOT NULL) AS l FROM context WHERE r_h < 0 OR (r_h = 0 AND result = 'STOP_LOSS')))"""
_FLAGGED = f"""flagged AS (SELECT r_h, trend = CASE direction WHEN 'LONG' THEN 'BULLISH' ELSE 'BEARISH' END AS trend_alignment, CASE direction WHEN 'LONG' THEN rsi BETWEEN 45 AND 65 ELSE rsi BETWEEN 35 AND 55 END AS rsi_zone, CASE direction WHEN 'LONG' THEN macd_hist > 0 ELSE macd_hist < 0 END AS macd_side,
 coalesce(CASE direction WHEN 'LONG' THEN to_resistance >= 1 ELSE to_support >= 1 END, false) AS level_clearance, coalesce(to_ema50 <= 1.5, false) AS low_extension, {_SESSION} IN ('London', 'New York', 'London/NY Overlap') AS active_session FROM (SELECT *, (entry_time // 3600) % 24 AS h FROM context))"""

ORACLES = {
    "st1_headline": f"{_T} SELECT symbol, {_HEAD()} FROM trades GROUP BY 1",
    "st1_lineitem": f"WITH trades AS (SELECT *, r_h AS pnl, CASE WHEN r_h = 0 THEN 'EXPIRED' ELSE 'TP1' END AS result FROM (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) % 401 - 200 AS r_h, l_returnflag AS symbol, 1 + l_orderkey % 60 AS holding_minutes, CASE WHEN l_linenumber % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction FROM lineitem)) SELECT symbol, {_HEAD()} FROM trades GROUP BY 1",
    "st2_equity": f"{_T}, {_EQ('1')} SELECT trade_id, exit_time, CAST(equity AS BIGINT) AS equity, drawdown, drawdown_pct FROM eq",
    "st2_drawdown_long": f"{_L}, {_EQ('strength')} SELECT strength, max(drawdown) AS max_drawdown, max(drawdown_pct) AS max_drawdown_pct FROM eq GROUP BY 1",
    "st3_streaks": f"{_T}, {_RUN('symbol', 'r_h > 0', 'a')}, {_RUN('symbol', 'r_h < 0', 'b')} SELECT symbol, count(*) AS trades, coalesce(any_value(a.longest), 0) AS max_wins, coalesce(any_value(b.longest), 0) AS max_losses FROM trades LEFT JOIN a ON a.by_ = symbol LEFT JOIN b ON b.by_ = symbol GROUP BY 1",
    "st4_strength": f"{_T} SELECT strength, {_GROUP} FROM trades GROUP BY 1",
    "st5_direction": f"{_T}, {_EQ('direction')} SELECT direction, {_GROUP}, max(drawdown) AS max_drawdown, max(drawdown_pct) AS max_drawdown_pct FROM eq GROUP BY 1",
    "st6_session": f"{_S} SELECT session, {_GROUP} FROM sess GROUP BY 1",
    "st7_regime": f"{_T} SELECT CASE trade_id % 3 WHEN 0 THEN 'BULLISH' WHEN 1 THEN 'BEARISH' ELSE 'UNCLASSIFIED' END AS regime, {_GROUP} FROM trades GROUP BY 1",
    "st8_slice": f"""{_T}, {_EQ('symbol', 300)}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_time, seq) - 1 AS idx FROM eq), {_RUN('symbol', 'r_h > 0', 'a')}, {_RUN('symbol', 'r_h < 0', 'b')}, h AS (SELECT symbol, {_HEAD('NULL::DOUBLE')}, max(drawdown) AS max_drawdown, max(drawdown_pct) AS max_drawdown_pct, min(idx) FILTER (equity <= 0) AS depletion_index,
 coalesce(round({_W("r_h > 0 AND direction = 'LONG'")} * 100 / nullif({_W("direction = 'LONG'")}, 0), 6), 0.0) AS long_win_rate, coalesce(sum(r_h) FILTER (direction = 'LONG'), 0)::DOUBLE / 100 AS long_total_r, coalesce(round({_W("r_h > 0 AND direction = 'SHORT'")} * 100 / nullif({_W("direction = 'SHORT'")}, 0), 6), 0.0) AS short_win_rate, coalesce(sum(r_h) FILTER (direction = 'SHORT'), 0)::DOUBLE / 100 AS short_total_r FROM n GROUP BY 1)
 SELECT h.*, coalesce(a.longest, 0) AS max_wins, coalesce(b.longest, 0) AS max_losses, depletion_index IS NULL AS solvent FROM h LEFT JOIN a ON a.by_ = symbol LEFT JOIN b ON b.by_ = symbol""",
    "st9_expectancy": f"{_T}, f AS (SELECT symbol, round({_W('r_h > 0')} / count(*), 4) AS win_probability, round({_W('r_h < 0')} / count(*), 4) AS loss_probability, round(coalesce(avg(r_h) FILTER (r_h > 0), 0) / 100, 2) AS average_win_r, round(coalesce(-avg(r_h) FILTER (r_h < 0), 0) / 100, 2) AS average_loss_r FROM trades GROUP BY 1) SELECT *, coalesce(round(average_win_r / nullif(average_loss_r, 0), 4), 0) AS reward_risk, round(win_probability * average_win_r - loss_probability * average_loss_r, 5) AS expectancy FROM f",
    "st10_drawdowns": f"{_T}, {_EQ('symbol')}, {_RUN('symbol', 'drawdown > 0', 'u', 'eq')}, {_RUN('symbol', 'r_h < 0', 'b')} SELECT symbol, max(drawdown) AS max_drawdown, max(drawdown_pct) AS max_drawdown_pct, round(coalesce(avg(drawdown) FILTER (drawdown > 0), 0), 6) AS average_drawdown, {_W('drawdown > 0')} AS trades_under_water, coalesce(any_value(u.longest), 0) AS longest_under_water, coalesce(any_value(b.longest), 0) AS max_losing_streak, coalesce(round(any_value(b.mean), 6), 0) AS average_losing_streak, CASE WHEN max(drawdown) > 0 THEN round(sum(pnl)::DOUBLE / max(drawdown), 6) WHEN sum(pnl) > 0 THEN 999.0 ELSE 0.0 END AS recovery_factor FROM eq LEFT JOIN u ON u.by_ = symbol LEFT JOIN b ON b.by_ = symbol GROUP BY 1",
    "st11_monthly": f"{_L}, m AS (SELECT *, strftime(make_timestamp(entry_time * 1000000), '%Y-%m') AS month FROM trades), {_EQ('month', src='m')} SELECT month, {_GROUP}, max(drawdown) AS max_drawdown, max(drawdown_pct) AS max_drawdown_pct FROM eq GROUP BY 1",
    "st12_concentration": f"{_L}, m AS (SELECT strftime(make_timestamp(entry_time * 1000000), '%Y-%m') AS month, sum(r_h)::BIGINT AS h FROM trades GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY h DESC, month) AS n FROM m) SELECT sum(h)::DOUBLE / 100 AS total_r, "
    + ", ".join(f"CASE WHEN sum(h) > 0 THEN round(coalesce(sum(h) FILTER (n <= {k}), 0)::DOUBLE * 100 / sum(h), 6) ELSE 0.0 END AS top{k}_pct, (sum(h) - coalesce(sum(h) FILTER (n <= {k}), 0))::DOUBLE / 100 AS total_without_top{k}" for k in (1, 2, 3))
    + " FROM r",
    "val1_windows": f"SELECT window_index, train_start::BIGINT AS train_start, train_end::BIGINT AS train_end, val_start::BIGINT AS val_start, val_end::BIGINT AS val_end FROM (VALUES {', '.join(str(x) for x in windows.slices(788918400, 996624000))}) AS w(window_index, train_start, train_end, val_start, val_end)",
    "val3_walk_forward": f"{_WIN} SELECT * FROM wf",
    "st13_consistency": f"{_WIN} SELECT count(*) AS windows, round({_W('total_r > 0')} / count(*), 6) AS positive_share, round({_W('profit_factor > 1')} / count(*), 6) AS factor_over_one_share, round(median(total_r), 6) AS median_r, round(coalesce(stddev_samp(total_r), 0), 6) AS std_r, 'W' || arg_max(window_index, (total_r, -window_index)) AS best, 'W' || arg_min(window_index, (total_r, window_index)) AS worst FROM wf",
    "st14_oos": f"{_WIN} SELECT count(*) AS windows, sum(trades)::BIGINT AS trades, sum(wins)::BIGINT AS wins, round(sum(total_r), 6) AS total_r, {_W('total_r > 0')} AS positive, {_W('total_r <= 0')} AS negative, max(max_drawdown) AS max_drawdown FROM wf",
    "st15_distribution": f"{_T} {_DIST('r', 'direction')}",
    "st16_percentiles": f"{_T} SELECT symbol, {', '.join(f'round(quantile_cont(r, {p}), 6) AS p{round(p * 100)}' for p in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM trades GROUP BY 1",
    "st17_buckets": f"""{_S} SELECT session, count(*) AS trades, round({_W('r_h > 0')} * 100 / count(*), 6) AS win_rate, sum(r_h)::DOUBLE / 100 AS total_r, round(avg(r_h) / 100, 6) AS average_r, round({_W("result = 'STOP_LOSS' AND holding_minutes <= 3")} * 100 / count(*), 6) AS early_stop_rate, round(count(*) * 100 / (SELECT count(*) FROM sess), 6) AS share, {_PF('0.0')} FROM sess GROUP BY 1""",
    "st18_slice_r": f"{_T}, {_EQ('symbol', 0)}, {_RUN('symbol', 'r_h > 0', 'a')}, {_RUN('symbol', 'r_h < 0', 'b')} SELECT symbol, count(*) AS trades, round({_W('r_h > 0')} * 100 / count(*), 6) AS win_rate, sum(r_h)::DOUBLE / 100 AS total_r, round(avg(r_h) / 100, 6) AS average_r, {_PF('0.0')}, max(drawdown) / 100 AS max_drawdown_r, coalesce(any_value(a.longest), 0) AS max_wins, coalesce(any_value(b.longest), 0) AS max_losses FROM eq LEFT JOIN a ON a.by_ = symbol LEFT JOIN b ON b.by_ = symbol GROUP BY 1",
    "st19_delta": f"{_T}, a AS (SELECT symbol, {_HEAD()} FROM trades GROUP BY 1), b AS (SELECT symbol, {_HEAD()} FROM trades WHERE strength >= 8 GROUP BY 1), e AS (SELECT a.symbol, a.trades AS t0, b.trades AS t1, a.total_r AS ar, b.total_r AS br, a.win_rate AS aw, b.win_rate AS bw, a.win_rate / 100 * a.average_win_r - (1 - a.win_rate / 100) * abs(a.average_loss_r) AS ae, b.win_rate / 100 * b.average_win_r - (1 - b.win_rate / 100) * abs(b.average_loss_r) AS be FROM a JOIN b USING (symbol)) SELECT symbol, t1 - t0 AS d_trades, round(br - ar, 6) AS d_total_r, round(bw - aw, 6) AS d_win_rate, round(be - ae, 6) AS d_expectancy, CASE WHEN t1 < t0 THEN round((t0 - t1) * 100 / t0, 6) ELSE 0.0 END AS reduction_pct FROM e",
    "st20_journal": f"{_JOURNAL} SELECT epoch_s // 86400 AS day, {', '.join(_W(f'state = {s!r}') + f' AS {s.lower()}' for s in ('FILLED', 'TIMED_OUT', 'INVALIDATED', 'BLOCKED', 'CLOSED'))}, count(r_h) AS trades, coalesce(sum(r_h), 0)::DOUBLE / 100 AS total_r, {_PF('1.0')} FROM j GROUP BY 1",
    "str10_journal_tail": f"{_JOURNAL} SELECT event_id, state, k FROM j WHERE epoch_s >= 1704844800 ORDER BY event_id DESC LIMIT 50",
    "st21_correlations": f"{_T} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM trades" for i, a in enumerate(("r_h", "holding_minutes", "strength", "entry_time")) for b in ("r_h", "holding_minutes", "strength", "entry_time")[i + 1 :]),
    "for3_stopped": f"{_TC} SELECT symbol, direction, {_W("result = 'STOP_LOSS'")} AS stopped, {_W("result = 'STOP_LOSS' AND later_r >= 1")} AS then_1r, {_W("result = 'STOP_LOSS' AND later_r >= 2")} AS then_2r FROM context GROUP BY 1, 2",
    "for4_tags": f"{_TC}, {_TAGGED} SELECT trade_id, r_h, array_to_string(tags, '|') AS labels FROM tagged",
    "for5_categories": f"{_TC}, {_TAGGED}, each AS (SELECT unnest(tags) AS tag, r_h FROM tagged) SELECT tag, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM tagged), 6) AS share, round(avg(r_h) / 100, 6) AS average_r FROM each GROUP BY 1",
    "for6_grouping_sets": f"{_T} SELECT strength, coalesce(direction, 'ALL') AS direction, count(*) AS trades, round({_W('r_h > 0')} * 100 / count(*), 6) AS win_rate, round(avg(r_h) / 100, 6) AS average_r FROM trades GROUP BY GROUPING SETS ((strength), (strength, direction))",
    "for7_contrast": f"{_TC}, {_FLAGGED} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS condition, {_W(n)} AS present, count(*) - {_W(n)} AS absent, round({_W(f'{n} AND r_h > 0')} * 100 / nullif({_W(n)}, 0), 6) AS present_win_rate, round({_W(f'NOT {n} AND r_h > 0')} * 100 / nullif(count(*) - {_W(n)}, 0), 6) AS absent_win_rate, round({_W(f'{n} AND r_h < 0')} * 100 / nullif({_W(n)}, 0), 6) AS present_loss_rate, round(avg(r_h) FILTER ({n}) / 100, 6) AS present_r, round(avg(r_h) FILTER (NOT {n}) / 100, 6) AS absent_r, round(round({_W(f'{n} AND r_h > 0')} * 100 / nullif({_W(n)}, 0), 6) - round({_W(f'NOT {n} AND r_h > 0')} * 100 / nullif(count(*) - {_W(n)}, 0), 6), 6) AS delta_win_rate, round(round(avg(r_h) FILTER ({n}) / 100, 6) - round(avg(r_h) FILTER (NOT {n}) / 100, 6), 6) AS delta_r FROM flagged"
        for n in ("trend_alignment", "rsi_zone", "macd_side", "level_clearance", "low_extension", "active_session")
    ),
    "for8_outcomes": f"{_T}, o AS (SELECT *, CASE WHEN r_h > 0 THEN 'WIN' ELSE 'LOSS' END AS outcome FROM trades WHERE r_h <> 0) {_DIST('holding_minutes', 'outcome', 'o')}",
    "for9_holding": f"{_T} SELECT CASE WHEN holding_minutes < 5 THEN '0-5' WHEN holding_minutes < 15 THEN '5-15' WHEN holding_minutes < 30 THEN '15-30' WHEN holding_minutes <= 60 THEN '30-60' END AS bucket, {_GROUP} FROM trades GROUP BY 1",
    "for10_losses": f"{_S} SELECT session, {_W('r_h < 0')} AS losses, round({_W('r_h < 0')} * 100 / (SELECT count(*) FROM sess WHERE r_h < 0), 6) AS share FROM sess GROUP BY 1",
    "for15_cube": f"{_S} SELECT session, strength, direction, count(*) AS trades, round({_W('r_h > 0')} * 100 / count(*), 6) AS win_rate, round(avg(r_h) / 100, 6) AS average_r FROM sess GROUP BY CUBE (session, strength, direction) HAVING count(*) >= 100",
    "aud2_overlaps": f"{_T} SELECT symbol, count(*) AS trades, count(*) FILTER (nxt < exit_time) AS overlaps FROM (SELECT *, lead(entry_time) OVER (PARTITION BY symbol ORDER BY entry_time, seq) AS nxt FROM trades) GROUP BY 1",
    "exp5_reconcile": f"{_T}, o AS (SELECT trade_id, r_h + CASE WHEN trade_id % 10 = 0 THEN 5 ELSE 0 END AS r_h FROM trades WHERE strength >= 8) SELECT CASE WHEN o.trade_id IS NULL THEN 'removed' WHEN t.trade_id IS NULL THEN 'added' WHEN abs(o.r_h - t.r_h) > 1 THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS n, sum(coalesce(o.r_h, 0) - coalesce(t.r_h, 0))::BIGINT AS d_h FROM trades t FULL JOIN o ON o.trade_id = t.trade_id GROUP BY 1",
}
