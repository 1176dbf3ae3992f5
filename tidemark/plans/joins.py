"""As-of and interval joins as equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.scan import last_known


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with values of the last row of right that is not later, null if there is none.

    Both sides are laid in one column of time (whole seconds) and scanned by
    days: a row of right stands before one of left of the same time, and the
    last row of right is carried from day to day. right has one row a time.
    """
    packed = F.struct(F.col(right_time).alias("_at"), *values)
    one = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_hit"))
    two = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_row"), packed.alias("_hit"))
    both = one.unionByName(two).withColumn("_day", F.floor(F.col("_t") / 86400))
    found = last_known(both, by, "_day", ["_t", "_side"], "_hit", "_found").where("_side = 1")
    return found.select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def interval(points: DataFrame, spans: DataFrame, by: list[str], time: str, start: str, end: str, width: int, closed_end: bool = True) -> DataFrame:
    """Pairs of spans and the points that lie in them (time in whole numbers), by equi-join on time slots of a width.

    A span is repeated for each slot it touches, so width should be about the
    length of a span. Columns of both sides are kept; by are those of spans.
    """
    slot = F.expr(f"sequence(floor({start} / {width}), floor({end} / {width}))")
    s = spans.where(F.col(end) >= F.col(start)).withColumn("_slot", F.explode(slot))
    p = points.withColumn("_slot", F.floor(F.col(time) / width))
    inside = (F.col(time) >= F.col(start)) & ((F.col(time) <= F.col(end)) if closed_end else (F.col(time) < F.col(end)))
    return s.join(p, [*by, "_slot"]).where(inside).drop("_slot")


def profit_factor(profit: Column, loss: Column, no_loss: float | None, digits: int = 6) -> Column:
    """profit / loss; without a loss no_loss if there is profit and 0 if not. no_loss None means null."""
    return F.when(loss > 0, F.round(profit / loss, digits)).when(profit > 0, F.lit(no_loss).cast("double")).otherwise(0.0)
