"""k-means with an automatic number of clusters, over one vector column.

The first centroids are fitted to at most about TRAIN_ROWS rows (a documented bound), drawn row by
row with a seed, so rows that are equal keep their share.  Where there are more rows than that,
rounds over all of them follow, in which each task adds up its rows by nearest centroid.  Rows are
assigned batch by batch, by array operations.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN_ROWS = 20_000
#: Rounds over all rows at most, after the fit to the training rows.
FULL_ROUNDS = 10


@dataclass
class KMeans:
    centroids: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    inertia: float
    n: int
    dropped: int


def _cells(features: list[str]) -> list[Column]:
    return [F.col(c).try_cast("double") for c in features]


def _finite(cells: list[Column]) -> Column:
    """Whether no cell is null, infinite or no number (which Spark takes for more than infinite)."""
    return reduce(Column.__and__, [F.abs(x) < float("inf") for x in cells])


def vector(features: list[str]) -> Column:
    """The features as an array of doubles, null where one is no finite number."""
    cells = _cells(features)
    return F.when(_finite(cells), F.array(*cells))


def _values(df: DataFrame, features: list[str], g: Column) -> DataFrame:
    """g and the complete rows' features as columns of their own, v0, v1, ...: no array is built of each row."""
    cells = _cells(features)
    return df.where(_finite(cells)).select(g.cast("int").alias("g"), *[x.alias(f"v{i}") for i, x in enumerate(cells)])


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow column of arrays of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, one column for each centroid, from differences: no digits are lost."""
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def _summaries(df: DataFrame, features: list[str], by: list[str] = ()) -> list[tuple]:
    """For each group (there are few) with complete rows: its values, their number, mean and scale, in one pass."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    v = df.select(*by, vector(features).alias("v")).where("v is not null")
    summary = Summarizer.metrics("mean", "variance").summary(array_to_vector("v"))
    out = []
    # a constant key: without complete rows there is no group, and nothing to summarise
    for r in v.groupBy(*(by or [F.lit(0).alias("_all")])).agg(F.count("*").alias("n"), summary.alias("s")).collect():
        mean, spread = r["s"]["mean"].toArray(), np.sqrt(r["s"]["variance"].toArray() * (r["n"] - 1) / r["n"])
        out.append((tuple(r[g] for g in by), r["n"], mean, np.where(spread > 1e-12, spread, 1.0)))
    return out


def _drawn(n: int) -> float:
    """The share of n rows to train on: the number drawn strays by far less than the twentieth left."""
    return 1.0 if n <= TRAIN_ROWS else 0.95 * TRAIN_ROWS / n


def _standardised(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (rows[np.lexsort(rows.T[::-1])] - mean) / scale


def _training(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(standardised training rows in order, mean, scale, complete rows, other rows)."""
    found = _summaries(df, features)
    if not found:
        raise ValueError("no complete rows")
    ((_, n, mean, scale),) = found
    v = df.select(vector(features).alias("v")).where("v is not null")
    if n > TRAIN_ROWS:
        v = v.sample(_drawn(n), 1)
    return _standardised(_matrix(v.toArrow()["v"].combine_chunks()), mean, scale), mean, scale, n, df.count() - n


def lloyd(z: np.ndarray, k: int, seed: int, restarts: int = 3, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Centroids and inertia; k-means++ starts, empty clusters take the farthest point."""
    best = None
    squares = (z**2).sum(1)
    for turn in range(restarts):
        rng = np.random.default_rng(seed + turn)
        c = z[[rng.integers(len(z))]]
        d = ((z - c[0]) ** 2).sum(1)
        while len(c) < k:
            c = np.vstack([c, z[rng.choice(len(z), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(z))]])
            d = np.minimum(d, ((z - c[-1]) ** 2).sum(1))
        for _ in range(rounds):
            d = (squares[:, None] - 2 * z @ c.T + (c**2).sum(1)).clip(min=0)
            own = d.argmin(1)
            new = np.array([z[own == j].mean(0) if (own == j).any() else z[d.min(1).argmax()] for j in range(k)])
            moved = ((new - c) ** 2).sum(1).max()
            c = new
            if moved < 1e-8:
                break
        inertia = float(_distances(z, c).min(1).sum())
        if best is None or inertia < best[1]:
            best = c, inertia
    return best


def full_rounds(v: DataFrame, models: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rounds: int = FULL_ROUNDS) -> list[tuple[np.ndarray, float, np.ndarray]]:
    """Centroids, inertia and rows of each centroid after rounds over all rows of v (g: place of the row's model; v0, v1, ...).

    models: centroids, mean, scale.  A task gives out sums for each centroid only; a centroid without
    rows stays where it is.  Inertia and rows are those of the centroids before the last move.
    """
    centroids = [c for c, *_ in models]
    width = len(models[0][1])
    names = ["g", *[f"v{i}" for i in range(width)]]
    for _ in range(rounds):

        def sums(batches, centroids=centroids):
            n, far, total = ([np.zeros((len(c), *shape)) for c in centroids] for shape in ((), (), (width,)))
            for batch in batches:
                if not batch.num_rows:
                    continue
                g, *x = (batch.column(c).to_numpy() for c in names)
                for i in np.unique(g):
                    mine = g == i
                    z = [(c[mine] - m) / s for c, m, s in zip(x, *models[i][1:])]
                    least, own = np.full(len(z[0]), np.inf), np.zeros(len(z[0]), np.int64)
                    for k, centroid in enumerate(centroids[i]):
                        d = sum((c - m) ** 2 for c, m in zip(z, centroid))
                        own[d < least] = k
                        least = np.minimum(least, d)
                    n[i] += np.bincount(own, minlength=len(n[i]))
                    far[i] += np.bincount(own, least, len(n[i]))
                    for j, c in enumerate(z):
                        total[i][:, j] += np.bincount(own, c, len(n[i]))
            places = [(i, k) for i, c in enumerate(centroids) for k in range(len(c)) if n[i][k]]
            columns = zip(*[(i, k, int(n[i][k]), far[i][k], total[i][k].tolist()) for i, k in places]) if places else [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["g", "k", "n", "far", "total"])

        parts = v.mapInArrow(sums, "g int, k int, n long, far double, total array<double>")
        by = parts.groupBy("g", "k").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
        new, inertia, rows = [c.copy() for c in centroids], [0.0] * len(models), [np.zeros(len(c), np.int64) for c in centroids]
        for r in by.collect():  # a row for each centroid
            inertia[r["g"]] += r["far"]
            rows[r["g"]][r["k"]] = r["n"]
            new[r["g"]][r["k"]] = np.array(r["total"]) / r["n"]
        moved = max(((a - b) ** 2).sum(1).max() for a, b in zip(new, centroids))
        centroids = new
        if moved < 1e-8:
            break
    return list(zip(centroids, inertia, rows))


def kmeans(df: DataFrame, features: list[str], k: int = 3, seed: int = 42) -> KMeans:
    if not 2 <= k <= 50:
        raise ValueError("k must be from 2 to 50")
    z, mean, scale, n, dropped = _training(df, features)
    c, inertia = lloyd(z, min(k, len(z)), seed, 3 if n <= TRAIN_ROWS else 1)
    if n > TRAIN_ROWS:
        ((c, inertia, _),) = full_rounds(_values(df, features, F.lit(0)), [(c, mean, scale)])
    c = c[np.lexsort(c.T[::-1])]
    return KMeans(c * scale + mean, mean, scale, inertia, n, dropped)


def kmeans_groups(df: DataFrame, by: list[str], shown: list[tuple], features: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    """cluster, count, by, error: clusters of each shown group (there are few), all in the same jobs.

    One pass summarises all groups, one fits each to at most about TRAIN_ROWS of its rows in a task of
    its own, and one moves the centroids by all rows and counts them, or as many as it takes for a
    group with more rows.
    """
    if not 2 <= k <= 50:
        raise ValueError("k must be from 2 to 50")
    spark = df.sparkSession
    names = spark.createDataFrame([(*v, i) for i, v in enumerate(shown)], df.select(*by).schema.add("_g", T.IntegerType()))
    known = df.join(F.broadcast(names), by)  # a few rows
    fitted = {key[0]: (n, mean, scale) for key, n, mean, scale in _summaries(known, features, ["_g"])}
    v = known.select(F.col("_g").alias("g"), vector(features).alias("v")).where("v is not null")
    found: dict[int, np.ndarray] = {}
    if fitted:
        share = F.element_at(F.create_map(*[F.lit(x) for g, s in fitted.items() for x in (g, _drawn(s[0]))]), F.col("g"))

        def fit(key: tuple, rows: pa.Table) -> pa.Table:
            n, mean, scale = fitted[key[0].as_py()]
            z = _standardised(_matrix(rows["v"].combine_chunks()), mean, scale)
            c, _ = lloyd(z, min(k, len(z)), seed, 3 if n <= TRAIN_ROWS else 1)
            c = c[np.lexsort(c.T[::-1])]
            return pa.table({"g": pa.array([key[0].as_py()] * len(c), pa.int32()), "c": pa.array(c.tolist(), pa.list_(pa.float64()))})

        for r in v.where(F.rand(1) < share).groupBy("g").applyInArrow(fit, "g int, c array<double>").collect():
            found.setdefault(r["g"], []).append(r["c"])
    order = sorted(found)
    rows = []
    if order:
        place = F.element_at(F.create_map(*[F.lit(x) for i, g in enumerate(order) for x in (g, i)]), F.col("_g"))
        many = max(fitted[g][0] for g in order) > TRAIN_ROWS
        models = [(np.array(found[g]), *fitted[g][1:]) for g in order]
        for g, (_, _, count) in zip(order, full_rounds(_values(known.where(F.col("_g").isin(order)), features, place), models, FULL_ROUNDS if many else 1)):
            rows += [(i, int(n), *shown[g], None) for i, n in enumerate(count) if n]
    rows += [(None, None, *values, "no complete rows") for g, values in enumerate(shown) if g not in found]
    kinds = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("count", T.LongType()), *df.select(*by).schema.fields, T.StructField("error", T.StringType())])
    return spark.createDataFrame(rows, kinds)


def assign(df: DataFrame, features: list[str], model: KMeans) -> DataFrame:
    """Rows without gaps, with a column cluster: the nearest centroid, ties to the least."""
    centroids, scale = model.centroids / model.scale, model.scale

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        x = _matrix(v) / scale if len(v) else np.zeros((0, len(scale)))
        return pa.array(_distances(x, centroids).argmin(1), pa.int32())

    whole = df.withColumn("_v", vector(features)).where("_v is not null")
    return whole.withColumn("cluster", nearest("_v")).drop("_v")


def elbow(df: DataFrame, features: list[str], k_max: int = 10, seed: int = 42) -> tuple[list[tuple[int, float]], int]:
    """(k, inertia) for k = 1, 2, ... and the k farthest below the line from the first to the last."""
    z, _, _, n, _ = _training(df, features)
    k_max = min(max(2, min(k_max, 20)), len(z))
    curve = [(1, float((z**2).sum()))] + [(k, lloyd(z, k, seed, 3 if n <= TRAIN_ROWS else 1)[1]) for k in range(2, k_max + 1)]
    ks, y = np.array([k for k, _ in curve], float), np.array([v for _, v in curve])
    if len(curve) < 3:
        return curve, curve[-1][0]
    if y[0] - y[-1] <= 0:
        return curve, curve[0][0]
    drop = 1 - (ks - ks[0]) / (ks[-1] - ks[0]) - (y - y[-1]) / (y[0] - y[-1])
    return curve, int(ks[int(drop.argmax())])
