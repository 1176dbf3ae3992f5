"""The place of every row in a total order, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

#: Bits that monotonically_increasing_id gives to the place within a partition.
PLACE_BITS = 33


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its rows numbered from 1 in an order.

    Rows are dealt by sampled ranges of the order and sorted within them, so a
    row knows its place in its partition; partitions are counted, and what lies
    before each is added. The dealt rows are written once, as ranges are sampled
    anew whenever they are computed. Rows of equal order are dealt by chance, so
    many of them do not meet in one task; which of them comes first is open.
    """
    dealt = df.withColumn("_tie", F.rand(7)).repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order).drop("_tie")
    rows = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", PLACE_BITS))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # a row a partition
    before, starts = 0, []
    for part, n in counts:
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    place = F.col("_before") + F.col("_at") % (1 << PLACE_BITS) + 1
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, place).drop("_part", "_at", "_before")
