"""Checks, cleaning and coverage of bar histories (DQ), and upserts (SNK3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.slices import halo, own

PRICES = ("open", "high", "low", "close")


def invalid_reason(tolerance: float = 0.001, signed: bool = False) -> Column:
    """The first rule a bar breaks, null if none (DQ1): malformed, non-positive, high below low, high or low within the body.

    signed is for what may be quoted at nothing or below, as amounts and spreads are: no bar is non-positive then.
    """
    cast = {c: F.expr(f"try_cast({c} AS double)") for c in PRICES}
    return (
        F.when(F.expr("try_cast(epoch_s AS bigint)").isNull() | F.array_contains(F.array(*[v.isNull() for v in cast.values()]), True), "malformed")
        .when(F.lit(not signed) & (F.least(*cast.values()) <= 0), "non_positive")
        .when(cast["high"] < cast["low"], "high_below_low")
        .when(cast["high"] + tolerance < F.greatest(cast["open"], cast["close"]), "high_below_body")
        .when(cast["low"] - tolerance > F.least(cast["open"], cast["close"]), "low_above_body")
    )


def clean(raw: DataFrame, by: list[str], signed: bool = False) -> DataFrame:
    """Valid bars, of each time the one that arrived first (DQ2), prices rounded to hundredths."""
    w = Window.partitionBy(*by, "epoch_s").orderBy("seq")
    kept = raw.withColumn("_bad", invalid_reason(signed=signed)).where("_bad IS NULL").drop("_bad")
    kept = kept.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return kept.withColumns({c: F.round(F.col(c).cast("double"), 2) for c in PRICES})


def cleaning_report(raw: DataFrame, by: list[str], signed: bool = False) -> DataFrame:
    """For each key how many bars came, are invalid, out of order on arrival, and repeated (DQ2)."""
    bad = invalid_reason(signed=signed).isNotNull()
    rows, keys = halo(raw.where(~bad), by, ["seq"], 1)
    w = Window.partitionBy(*keys).orderBy("seq")
    valid = own(rows.withColumn("_back", F.col("epoch_s") < F.lag("epoch_s").over(w)))
    counts = valid.groupBy(*by).agg(F.count(F.lit(1)).alias("valid"), F.count_if("_back").alias("inversions"), F.countDistinct("epoch_s").alias("kept"))
    every = raw.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("invalid"))
    return every.join(counts, by, "left").select(*by, "total", "invalid", F.coalesce(F.col("valid") - F.col("kept"), F.lit(0)).alias("duplicates"), F.coalesce("inversions", F.lit(0)).alias("inversions"), F.coalesce("kept", F.lit(0)).alias("kept"))


def _steps(bars: DataFrame, by: list[str]) -> DataFrame:
    """from_s and to_s: the time of each bar and of the one before it, null at first."""
    rows, keys = halo(bars.select(*by, "epoch_s"), by, ["epoch_s"], 1)
    w = Window.partitionBy(*keys).orderBy("epoch_s")
    return own(rows.withColumn("from_s", F.lag("epoch_s").over(w))).select(*by, "from_s", F.col("epoch_s").alias("to_s"))


def gaps(bars: DataFrame, by: list[str], over: int = 300, unexpected_over: int = 900, night: int = 7200) -> DataFrame:
    """Steps longer than over seconds (DQ3): from_s, to_s, gap_s, kind.

    Expected after Friday 20:00 UTC, on weekends, and for up to night seconds
    from 21:00 or 22:00; else unexpected if longer than unexpected_over, else small.
    """
    g = _steps(bars, by).withColumn("gap_s", F.col("to_s") - F.col("from_s")).where(F.col("gap_s") > over)
    t = F.timestamp_seconds("from_s")
    day, hour = F.weekday(t), F.hour(t)
    expected = ((day == 4) & (hour >= 20)) | (day >= 5) | (hour.isin(21, 22) & (F.col("gap_s") <= night))
    return g.withColumn("kind", F.when(expected, "expected").when(F.col("gap_s") > unexpected_over, "unexpected").otherwise("small"))


def alignment(primary: DataFrame, trigger: DataFrame, by: list[str], tolerance: int = 600) -> DataFrame:
    """Do two histories begin and end together (DQ4)? PASS, WARN, or FAIL where one is missing."""
    a = primary.groupBy(*by).agg(F.min("epoch_s").alias("p0"), F.max("epoch_s").alias("p1"))
    b = trigger.groupBy(*by).agg(F.min("epoch_s").alias("t0"), F.max("epoch_s").alias("t1"))
    both = a.join(b, by, "full_outer")
    status = F.when(F.col("p0").isNull() | F.col("t0").isNull(), "FAIL").when((F.abs(F.col("p0") - F.col("t0")) > tolerance) | (F.abs(F.col("p1") - F.col("t1")) > tolerance), "WARN").otherwise("PASS")
    return both.select(*by, (F.col("t0") - F.col("p0")).alias("start_offset"), (F.col("t1") - F.col("p1")).alias("end_offset"), status.alias("status"))


def line(timeframe: str) -> Column:
    """A bar as the text that fingerprints are taken of: timeframe:time:open:high:low:close;"""
    cents = lambda c: F.format_string("%d.%02d", F.floor(F.round(F.col(c) * 100) / 100).cast("long"), F.pmod(F.round(F.col(c) * 100).cast("long"), F.lit(100)))
    return F.concat(F.lit(timeframe), F.lit(":"), F.col("epoch_s").cast("string"), *[x for c in PRICES for x in (F.lit(":"), cents(c))], F.lit(";"))


def fingerprint(bars: DataFrame, by: list[str], timeframe: str, chunk: int = 100_000) -> DataFrame:
    """A digest of each history in order of time (DQ5).

    Bars are digested in chunks by time, then the chunks' digests in order, so no
    task holds a whole history. The value is that of this two-level digest.
    """
    part = F.floor(F.col("epoch_s") / chunk)
    chunks = bars.groupBy(*by, part.alias("part")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("epoch_s", line(timeframe).alias("line")))), lambda x: x["line"]), ""), 256).alias("digest"))
    return chunks.groupBy(*by).agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), ""), 256), 1, 16).alias("fingerprint"))


def coverage(bars: DataFrame, by: list[str], requested_days: int = 360) -> DataFrame:
    """Days from first to last bar, the class they make, and completeness at 90 percent of what was asked (DQ6)."""
    days = (F.max("epoch_s") - F.min("epoch_s")) / 86400
    c = bars.groupBy(*by).agg(F.count(F.lit(1)).alias("bars"), F.min("epoch_s").alias("first_s"), F.max("epoch_s").alias("last_s"), F.round(days, 6).alias("days"))
    status = F.when(F.col("days") < 180, "INSUFFICIENT").when(F.col("days") < 350, "LIMITED").otherwise("12-MONTH")
    return c.withColumns({"status": status, "complete": F.col("days") >= 0.9 * requested_days})


def audit(raw: DataFrame, by: list[str], requested_days: int = 360, signed: bool = False) -> DataFrame:
    """One row a key: cleaning counts, gap counts, coverage; clean ignores repeats (DQ6)."""
    kept = clean(raw, by, signed)
    g = gaps(kept, by).groupBy(*by).agg(F.count_if(F.col("kind") == "expected").alias("expected_gaps"), F.count_if(F.col("kind") == "unexpected").alias("unexpected_gaps"))
    out = cleaning_report(raw, by, signed).join(coverage(kept, by, requested_days), by, "left").join(g, by, "left")
    out = out.fillna(0, ["expected_gaps", "unexpected_gaps"])
    return out.withColumn("is_clean", (F.col("invalid") == 0) & (F.col("inversions") == 0) & (F.col("unexpected_gaps") == 0))


def missing_ranges(bars: DataFrame, by: list[str], start: Column, end: Column, slack: int = 2 * 86400) -> DataFrame:
    """Head and tail of start..end that a history lacks by more than slack seconds (DQ7): from_s, to_s, part."""
    c = bars.groupBy(*by).agg(F.min("epoch_s").alias("lo"), F.max("epoch_s").alias("hi")).withColumns({"s": start, "e": end})
    head = F.when(F.col("lo") - F.col("s") > slack, F.struct(F.col("s").alias("from_s"), F.col("lo").alias("to_s"), F.lit("head").alias("part")))
    tail = F.when(F.col("e") - F.col("hi") > slack, F.struct(F.col("hi").alias("from_s"), F.col("e").alias("to_s"), F.lit("tail").alias("part")))
    return c.select(*by, F.explode(F.array_compact(F.array(head, tail))).alias("x")).select(*by, "x.*")


def inner_gaps(bars: DataFrame, by: list[str], step: int) -> DataFrame:
    """Holes inside a history, which head and tail do not show (DQ7, extended): from_s, to_s, missing bars."""
    g = _steps(bars, by).withColumn("from_s", F.col("from_s") + step)
    return g.where(F.col("to_s") > F.col("from_s")).withColumn("missing", ((F.col("to_s") - F.col("from_s")) / step).cast("long"))


def horizons(bars: DataFrame, by: list[str], days: list[int]) -> DataFrame:
    """Bars within each of some look-backs from the last bar, in one pass (DQ9): days, bars."""
    last = bars.groupBy(*by).agg(F.max("epoch_s").alias("last_s"))
    hit = bars.join(last, by).groupBy(*by).agg(*[F.count_if(F.col("epoch_s") >= F.col("last_s") - d * 86400).alias(f"d{d}") for d in days])
    return hit.select(*by, F.explode(F.array(*[F.struct(F.lit(d).alias("days"), F.col(f"d{d}").alias("bars")) for d in days])).alias("x")).select(*by, "x.*")


def status(bars: DataFrame, by: list[str], cap: int = 100_000) -> DataFrame:
    """Counts and spans of each history, and whether the source's cap was met (DQ10)."""
    return bars.groupBy(*by).agg(F.count(F.lit(1)).alias("bars"), F.min("epoch_s").alias("first_s"), F.max("epoch_s").alias("last_s")).withColumns({"days": F.round((F.col("last_s") - F.col("first_s")) / 86400, 6), "capped": F.col("bars") == cap})


def upsert(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Both histories; where both have a time the new bar wins (SNK3)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*by, "epoch_s").orderBy(F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def refresh(held: DataFrame, source: DataFrame, by: list[str], start: int, end: int, slack: int = 2 * 86400, signed: bool = False) -> DataFrame:
    """Load what a history lacks of start..end from its source, merge and clean it (DQ8).

    Of each key the head and tail that missing_ranges() names are read, of a key
    that held does not have all of start..end; where both have a time, what is
    read anew wins. Both sides need seq, the order of arrival. audit() judges the result.
    """
    spans = held.groupBy(*by).agg(F.min("epoch_s").alias("_lo"), F.max("epoch_s").alias("_hi"))
    head = (F.lit(start) < F.col("_lo") - slack) & (F.col("epoch_s") <= F.col("_lo"))
    tail = (F.lit(end) > F.col("_hi") + slack) & (F.col("epoch_s") >= F.col("_hi"))
    wanted = source.where(F.col("epoch_s").between(start, end)).join(spans, by, "left")
    new = wanted.where(F.col("_lo").isNull() | head | tail).drop("_lo", "_hi")
    return clean(upsert(held, new, by), by, signed)
