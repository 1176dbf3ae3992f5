"""Hypotheses given as SQL, Columns and functions of batches."""

from pyspark.sql import functions as F

from tidemark.operators import hypotheses
from tidemark.operators.hypotheses import Hypothesis


def test_predicates_of_three_kinds_in_one_pass(spark):
    rows = spark.createDataFrame([("LONG_SETUP", 1, 5), ("SHORT_SETUP", 2, None), ("WAIT", 3, 7)], "type string, x long, y long")
    some = (Hypothesis("sql", "", "y > 4"), Hypothesis("column", "", F.col("x") == 2), Hypothesis("function", "", lambda b: b.x + b.y.fillna(0) > 2), Hypothesis("never", "", "y IS NULL AND x > 2"))
    assert {r.x: r.kept for r in hypotheses.judged(rows, some).collect()} == {1: [True, False, True, False], 2: [False, True, False, False], 3: [True, False, True, False]}
    assert {(r.x, r.only) for r in hypotheses.tagged(rows, some).collect()} == {(1, "sql"), (1, "function"), (2, "column")}
    assert [tuple(r) for r in hypotheses.summary(rows, "x", some).collect()] == [("sql", 2, 1, 1), ("column", 2, 1, 2), ("function", 2, 1, 1), ("never", 2, 0, 0)]
    assert len({h.id for h in hypotheses.HYPOTHESES}) == 12
