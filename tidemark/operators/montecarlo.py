"""Bootstrap of trade returns (VAL7): simulations dealt over tasks, each seeded by its own number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stats import CAPITAL

#: Distinct returns and their counts are broadcast; returns have two decimals, so there are few.
MOST_VALUES = 1_000_000
#: Trades drawn at once by a simulation: they and what is made of them stay in a core's cache.
CHUNK = 1 << 16
#: Stands in a lookup for cells of draws that belong to several returns.
_MIXED = np.iinfo(np.int64).min


def lookup(values: np.ndarray, upto: np.ndarray) -> tuple[int, np.ndarray]:
    """A shift, and the return of all draws that are the same after it; _MIXED where they have several.

    There are sixteen times as many cells as returns, so few draws are left to be searched for.
    """
    n, cells = int(upto[-1]), max(1 << 16, 16 * len(values))
    shift = max(0, (n // cells).bit_length())
    first = np.arange(((n - 1) >> shift) + 1, dtype=np.int64) << shift
    a, b = (np.searchsorted(upto, x, "right") for x in (first, np.minimum(first + (1 << shift) - 1, n - 1)))
    return shift, np.where(a == b, values[a], _MIXED)


def _has_run(loss: np.ndarray, length: int) -> bool:
    """Whether so many losses follow each other."""
    run = 1
    while run < length and len(loss):
        step = min(run, length - run)
        loss, run = loss[:-step] & loss[step:], run + step
    return bool(loss.any())


def simulation(sim: int, seed: int, values: np.ndarray, upto: np.ndarray, table: tuple[int, np.ndarray], risk_usd: int = 100) -> tuple[int, float, float, int]:
    """One simulation: its number, max drawdown, ending return, longest losing run; sums are in whole hundredths."""
    rng, n, (shift, cell) = np.random.default_rng([seed, sim]), int(upto[-1]), table
    kind = np.uint32 if n < 1 << 32 else np.int64  # the same draws either way
    left, total, peak, worst, streak, longest = n, 0, 0, 0, 0, 0
    while left:
        m = min(left, CHUNK)
        draws = rng.integers(0, n, m, dtype=kind)
        r = cell.take((draws >> shift).astype(np.intp), mode="wrap")
        search = np.flatnonzero(r == _MIXED)
        r[search] = values[np.searchsorted(upto, draws[search].astype(np.int64), "right")]
        equity = np.cumsum(r)
        equity += total
        top = np.maximum.accumulate(equity)
        np.maximum(top, peak, out=top)
        total, peak, left = int(equity[-1]), int(top[-1]), left - m
        top -= equity
        worst = max(worst, int(top.max()))
        loss = r < 0
        if loss.all():
            streak += m
            longest = max(longest, streak)
            continue
        longest = max(longest, streak + int(loss.argmin()))
        streak = int(loss[::-1].argmin())
        longest = max(longest, streak)
        if _has_run(loss, longest + 1):
            longest = int(np.diff(np.flatnonzero(~loss)).max()) - 1
    return sim, worst * (risk_usd / 100), total / 100, longest


def simulate(trades: DataFrame, simulations: int = 5000, seed: int = 42, capital: int = CAPITAL, risk_usd: int = 100) -> DataFrame:
    """For each simulation of as many trades, drawn with replacement: max drawdown, ending return, longest losing run.

    Returns are counted first, so what is broadcast is their distinct values;
    more than MOST_VALUES of these is an error. A simulation draws and scans its
    trades in chunks. Drawdowns are the same whatever capital it starts with. No
    trades give no rows.
    """
    spark = trades.sparkSession
    counted = trades.groupBy("r_h").agg(F.count(F.lit(1)).alias("n")).where("r_h IS NOT NULL").orderBy("r_h")
    if counted.limit(MOST_VALUES + 1).count() > MOST_VALUES:
        raise ValueError("too many distinct returns for a bootstrap by counts")
    got = counted.toPandas()
    if not len(got) or simulations <= 0:
        return spark.createDataFrame([], "sim long, max_drawdown double, ending_r double, losing_streak long")
    values, upto = got.r_h.to_numpy(np.int64), np.cumsum(got.n.to_numpy(np.int64))
    shared = spark.sparkContext.broadcast((values, upto))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, u = shared.value
        table = lookup(v, u)
        for b in batches:
            yield pd.DataFrame([simulation(int(i), seed, v, u, table, risk_usd) for i in b.id], columns=["sim", "max_drawdown", "ending_r", "losing_streak"])

    tasks = max(1, min(simulations, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(simulations, numPartitions=tasks).mapInPandas(run, "sim long, max_drawdown double, ending_r double, losing_streak long")


def summary(sims: DataFrame) -> DataFrame:
    """Percentiles of drawdowns and ending returns by interpolation, and the extremes."""
    p = lambda c, q, n: F.round(F.percentile(c, q), 2).alias(n)
    return sims.agg(F.count(F.lit(1)).alias("simulations"), *[p("max_drawdown", q, f"drawdown_p{round(q * 100)}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)], *[p("ending_r", q, f"ending_r_p{round(q * 100)}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)], F.max("max_drawdown").alias("worst_drawdown"), F.max("losing_streak").alias("longest_losing_streak"))
