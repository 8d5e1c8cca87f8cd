"""Joins that must not send a side through the driver."""

from revtables.operators.interval_join import interval_join


def test_interval_join_sends_no_side_through_the_driver(spark):
    points = spark.createDataFrame([(1, 5), (1, 70), (2, 5)], "f long, at long")
    ranges = spark.createDataFrame([(1, 0, 9), (1, 0, 300), (2, 6, 9)], "f long, s long, e long")
    held = interval_join(points, ranges, ["f"], "at", "s", "e")
    assert sorted((r.f, r.at, r.s, r.e) for r in held.collect()) == [(1, 5, 0, 9), (1, 5, 0, 300), (1, 70, 0, 300)]
    assert "Broadcast" not in held._jdf.queryExecution().executedPlan().toString()
