"""Profiles and clusters of all groups in shared jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import cluster, groups, profile


def test_profiles_agree_with_one_at_a_time(spark):
    rng = np.random.default_rng(0)
    rows = [(t, int(i % 4), float(rng.normal()) if i % 9 else None, f"s{i % 7}", float("nan") if i % 5 == 0 else float(i)) for t in "ABC" for i in range(90)] + [(None, 1, 1.0, "x", 2.0)]
    df = spark.createDataFrame(rows, "tool string, g int, v double, s string, w double").repartition(5)
    got, total = groups.for_each(df, ["tool", "g"], "profile", columns=["v", "s", "w", "tool"])
    assert total == 12 and {r["error"] for r in got.collect()} == {None}
    names = [c for c in profile.profile(df).columns]
    found = {(r["tool"], r["g"], r["column"]): tuple(r[c] for c in names) for r in got.collect()}
    assert len(found) == 36
    for t, g in (("A", 0), ("C", 3)):
        for r in profile.profile(df.where((F.col("tool") == t) & (F.col("g") == g)).select("v", "s", "w")).collect():
            assert found[t, g, r["column"]] == pytest.approx(tuple(r[c] for c in names), nan_ok=True)


def test_clusters_of_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(f"T{t}", u, float(10 * c + rng.normal()), float(t)) for t in range(6) for u in range(6) for c in range(3) for _ in range(5 + c)]
    rows += [("T0", 0, None, 1.0)]
    df = spark.createDataFrame(rows, "tool string, u int, x double, y double").repartition(5)
    sc = spark.sparkContext

    def clusters(df, name):
        """Rows, total, and how many jobs they took."""
        sc.setJobGroup(name, "")
        got, total = groups.for_each(df, ["tool", "u"], "cluster", features=["x", "y"], k=3)
        rows = got.collect()
        jobs = len(sc.statusTracker().getJobIdsForGroup(name))
        sc.setJobGroup("", "")
        return rows, total, jobs

    rows, total, jobs = clusters(df, "all groups")
    _, few, few_jobs = clusters(df.where("tool = 'T1' and u < 2"), "two groups")
    assert (total, few) == (36, 2) and jobs <= few_jobs + 2
    by = {}
    for r in rows:
        by.setdefault((r["tool"], r["u"]), []).append(r["count"])
    assert len(by) == 36 and all(sorted(n) == [5, 6, 7] for n in by.values())


def test_errors_of_groups_are_kept(spark, monkeypatch):
    """A group without complete rows has an error, one of few rows few clusters, and one above the bound is moved by all rows."""
    monkeypatch.setattr(cluster, "TRAIN_ROWS", 500)
    rng = np.random.default_rng(2)
    rows = [("big", float(c * 8 + rng.normal())) for c in range(2) for _ in range(1500)] + [("none", None)] * 4 + [("one", 3.0)] * 5 + [("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = groups.for_each(df, ["g"], "cluster", features=["x"], k=2)[0].collect()
    found = {(r["g"], r["error"]): [] for r in got}
    for r in got:
        found[r["g"], r["error"]].append(r["count"])
    assert {k: sorted(v, key=str) for k, v in found.items()} == {("big", None): [1500, 1500], ("none", "no complete rows"): [None], ("one", None): [5], ("two", None): [1, 1]}
    with pytest.raises(ValueError):
        groups.for_each(df, ["g"], "cluster", features=["x"], k=1)


def test_rounds_read_plain_columns(spark):
    """Rows reach the rounds over all rows as plain columns, without a lambda or an array of each row; incomplete rows are left out."""
    rows = [("1.5", 2.0), ("x", 2.0), (None, 2.0), ("1", None), ("1", float("nan")), ("1", float("inf")), ("-inf", 1.0), ("-3", -4.0)]
    df = spark.createDataFrame(rows, "x string, y double")
    values = cluster._values(df, ["x", "y"], F.lit(0))
    assert sorted(map(tuple, values.collect())) == [(0, -3.0, -4.0), (0, 1.5, 2.0)]
    plan = values._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "array" not in plan
    complete = [[-3.0, -4.0], [1.5, 2.0]]
    vectors = df.select(cluster.vector(["x", "y"]).alias("v"))
    assert sorted(r["v"] for r in vectors.collect() if r["v"]) == complete
    assert "lambda" not in vectors._jdf.queryExecution().executedPlan().toString()
