import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import cluster


def test_training_keeps_the_share_of_equal_rows(spark):
    for value in (10.0, 11.0, 12.0, 13.0):
        df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, value).otherwise(F.col("id") / 60_000.0).alias("x"))
        z, mean, scale, n, dropped = cluster._training(df, ["x"])
        x = z[:, 0] * scale[0] + mean[0]
        assert (n, dropped) == (60_000, 0) and 15_000 < len(x) <= cluster.TRAIN_ROWS
        assert abs((abs(x - value) < 1e-6).mean() - 1 / 3) < 0.02


def test_few_distinct_rows(spark):
    df = spark.range(90_000).select((F.col("id") % 3 * 10.0).alias("x"))
    model = cluster.kmeans(df, ["x"], 3)
    assert [round(c, 6) for c in model.centroids[:, 0]] == [0, 10, 20] and cluster.elbow(df, ["x"], 3)[0][-1][1] < 1e-6


def test_all_rows_move_the_centroids(spark):
    """Above the bound of training rows the centroids are the means of all rows nearest to them."""
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(c * 6, 1, (9000, 3)) for c in range(3)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows] + [(None, 1.0, 2.0), (float("nan"), 1.0, 1.0)], "a double, b double, c double").repartition(6)
    model = cluster.kmeans(df, ["a", "b", "c"], 3)
    z, c = (rows - model.mean) / model.scale, (model.centroids - model.mean) / model.scale
    d = ((z[:, None] - c[None]) ** 2).sum(-1)
    own = d.argmin(1)
    assert (model.n, model.dropped) == (27_000, 2)
    assert np.allclose([z[own == j].mean(0) for j in range(3)], c, atol=1e-3) and abs(d.min(1).sum() / model.inertia - 1) < 1e-6
    got = {(r["a"], r["b"], r["c"]): r["cluster"] for r in cluster.assign(df, ["a", "b", "c"], model).collect()}
    assert [got[tuple(map(float, r))] for r in rows] == own.tolist()


def test_assign_keeps_columns_and_breaks_ties_low(spark):
    df = spark.createDataFrame([("p", 1.0, 5), ("q", 3.0, 6), ("r", None, 7), ("t", 2.0, 8)], "name string, x double, cluster_no int")
    model = cluster.KMeans(np.array([[1.0], [3.0]]), np.zeros(1), np.ones(1), 0.0, 4, 0)
    got = cluster.assign(df, ["x"], model)
    assert got.columns == ["name", "x", "cluster_no", "cluster"]
    assert {r["name"]: r["cluster"] for r in got.collect()} == {"p": 0, "q": 1, "t": 0}


def test_no_complete_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (float("inf"), 2.0)], "x double, y double")
    for df in (df, df.where("false")):
        with pytest.raises(ValueError, match="complete"):
            cluster.kmeans(df, ["x", "y"])
