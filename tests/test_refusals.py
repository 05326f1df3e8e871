"""Operators that must refuse: an ambiguous figure, sources of different length, turns that miss the total."""

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import report, traces
from tallyfold.operators import turns as tn

FACTS = "session_id long, turn_index long, target_id string, component string, cost_micros long, item_ref string, turn_ref string"
ROWS = [
    (1, 0, "file:/a.py", "direct", 5, "i1@line1", "u1@line2"), (1, 1, "file:/a.py", "direct", 3, "i2@line3", "u1@line2"), (1, 1, "file:/a.py", "carry", 2, None, "u2@line4"),
    (1, 1, "file:/a.pyx", "direct", 7, "i3@line5", "u2@line4"), (1, 1, None, "output", 1, None, "u2@line4"),
]


def test_one_figure_or_none(spark):
    facts = spark.createDataFrame(ROWS, FACTS)
    cost = lambda wanted: sorted(r.cost_micros for r in traces.one_figure(facts, wanted).collect())
    assert cost("direct:file:/a.py") == [3, 5] and cost("a.pyx") == [7] and cost("output:session") == [1]
    with pytest.raises(Exception, match="matches 3 figures: carry:file:/a.py, direct:file:/a.py, direct:file:/a.pyx"):
        cost("a.py")
    refs = {r.ref: r.facts for r in traces.source_refs(traces.one_figure(facts, "direct:file:/a.py")).collect()}
    assert refs == {"i1@line1": 1, "i2@line3": 1, "u1@line2": 2}


def test_zip_of_unequal_sources_is_refused(spark):
    left = spark.createDataFrame([("s", 5, "x"), ("s", 3, "y"), ("t", 1, "z")], "k string, at long, a string")
    right = spark.createDataFrame([("t", 9, "c"), ("s", 2, "a"), ("s", 8, "b")], "k string, line long, b string")
    both = tn.zipped(left, right, "k", [F.col("at")], [F.col("line")], "they differ")
    assert sorted((r.k, r.place, r.a, r.b) for r in both.collect()) == [("s", 1, "y", "a"), ("s", 2, "x", "b"), ("t", 1, "z", "c")]
    for short in (right.where("line < 9"), right.where("line < 8 or k = 't'")):
        with pytest.raises(Exception, match="they differ: k [st] at [12]"):
            tn.zipped(left, short, "k", [F.col("at")], [F.col("line")], "they differ").collect()


def test_curve_ends_at_the_total(spark):
    turns = spark.createDataFrame([(2, 0, 10), (1, 1, 4), (1, 0, 6)], "session_id long, turn_index long, total_micros long")
    marks = spark.createDataFrame([(1, 1)], "session_id long, turn_index long")
    total = spark.createDataFrame([(20,)], "total_micros long")
    got = sorted((r.session_id, r.turn_index, r.running_micros, r.running_share, r.compacted) for r in report.whole_curve(turns, marks, total).collect())
    assert got == [(1, 0, 6, 0.3, False), (1, 1, 10, 0.5, True), (2, 0, 20, 1.0, False)]
    with pytest.raises(Exception, match="do not add up"):
        report.whole_curve(turns, marks, total.withColumn("total_micros", F.lit(21).cast("long"))).collect()
