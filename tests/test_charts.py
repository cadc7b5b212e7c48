"""Axis marks and panels of charts."""

import math
import random

from statloom.operators import charts


def test_marks_enclose_the_range():
    rng = random.Random(1)
    for _ in range(2000):
        low = rng.choice([0, rng.uniform(-1e6, 1e6), rng.uniform(-1, 1)])
        high = low + 10 ** rng.uniform(-3, 6)
        about = rng.choice([2, 5, 10])
        marks = charts.nice_ticks(low, high, about)
        step = marks[1] - marks[0]
        assert marks[0] <= low + 1e-6 * step and marks[-1] >= high - 1e-6 * step and 2 <= len(marks) <= about + 2
        assert all(math.isclose(b - a, step, rel_tol=1e-4) for a, b in zip(marks, marks[1:]))
        inner = charts.ticks_within(low, high, about)
        assert inner == [low, high] or all(low - 1e-6 * step <= m <= high + 1e-6 * step for m in inner)
    assert charts.nice_ticks(3, 97) == [0, 20, 40, 60, 80, 100] and charts.nice_ticks(5, 5) == [4, 4.5, 5, 5.5, 6]
    assert charts.nice_ticks(7, 1, 3) == charts.nice_ticks(1, 7, 3) == [0, 2, 4, 6, 8] and charts.nice_ticks(float("nan"), 1) == [0, 1]
    assert charts.ticks_within(3, 97) == [20, 40, 60, 80] and charts.ticks_within(1.1, 1.2, 1) == [1.1, 1.2] and charts.ticks_within(2, 2) == [2, 2]


def test_panels_are_capped(spark):
    one = spark.createDataFrame([(x, i, 1.0) for x in range(3) for i in [None, *range(30)]], "x int, facet1 int, y double")
    marks, notes = charts.capped_facets(one)
    assert {r["facet1"] for r in marks.collect()} == {None, *range(11)} and len(notes) == 1
    assert charts.capped_facets(one, die_maps=True)[0].select("facet1").distinct().count() == 25
    two = spark.createDataFrame([(f"c{i}", f"r{j}", 1.0) for i in range(9) for j in range(4)], "facet1 string, facet2 string, v double")
    marks, notes = charts.capped_facets(two)
    assert marks.count() == 24 and notes == ["the first 6 values of facet1 are shown"]
    assert charts.capped_facets(two.where("facet1 < 'c3'"))[1] == []


def test_sample_points_do_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    from statloom.operators.profile import sample_points

    df = spark.range(20_000).select((F.col("id") % 997).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") / 7).alias("y"))
    same = [sorted(tuple(r) for r in sample_points(d, ["x", "y"], 500).collect()) for d in (df, df.repartition(13), df.coalesce(1))]
    assert same[0] == same[1] == same[2] and 400 < len(same[0]) < 1100
    assert 0.25 < sum(y == 1.0 for _, y in same[0]) / len(same[0]) < 0.42
