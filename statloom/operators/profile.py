"""Profiles, correlation and regression, each by one aggregation over columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written
from ..types import finite
from .running import quantiles_of

DISTINCT_CAP = 10_000
CORRELATED = 20
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Columns _c0, _c1, ... and their names: duplicate and case-variant names are no trouble."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), df.columns


def profile(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row for each column (and group): position, name, kind, count, nulls, distinct (capped), and for numeric ones mean, std, min, quartiles, max.

    Moments come from one pass; distinct counts and exact quartiles of all columns and groups from one
    aggregation to distinct cells.  Groups with a null are left out.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    p, names = positional(df.drop(*by))
    if by:
        p = df.select(*by, *[c for c in df.columns if c not in by]).toDF(*keys, *p.columns).dropna(subset=keys)
    if not names:
        return df.sparkSession.createDataFrame([], _PROFILE)
    kinds = p.schema.fields[len(by) :]
    numeric = [isinstance(f.dataType, NUMERIC) for f in kinds]
    # each cell is read as a number once
    p = p.withColumns({f"_v{i}": finite(F.col(f.name).cast("double")) for i, f in enumerate(kinds) if numeric[i]})
    moments: list[Column] = []
    cells: list[Column] = []
    no_number = F.lit(None).cast("double")
    for i, f in enumerate(kinds):
        c, v = F.col(f.name), F.col(f"_v{i}") if numeric[i] else no_number
        text = c if not isinstance(f.dataType, (T.MapType, T.VariantType)) else c.cast("string")
        digest = F.when(v.isNull(), F.xxhash64(text)) if numeric[i] else F.xxhash64(text)
        cells.append(F.when(c.isNotNull(), F.struct(F.lit(i).alias("position"), v.alias("v"), digest.alias("h"))))
        found = [F.avg(v), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))), F.min(v), F.max(v)] if numeric[i] else [no_number] * 4
        moments.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(names[i]).alias("column"), F.lit("numeric" if numeric[i] else "text").alias("kind"),
                F.count(c).alias("count"), (F.count("*") - F.count(c)).alias("nulls"), *[m.alias(n) for m, n in zip(found, ("mean", "std", "min", "max"))],
            ).alias(f"s{i}")
        )
    spot = [*keys, "position"]
    found = p.groupBy(*keys).agg(*moments).select(*keys, F.explode(F.array(*[f"s{i}" for i in range(len(names))])).alias("s")).select(*keys, "s.*")
    values = p.select(*keys, F.explode(F.array(*cells)).alias("c")).where("c is not null").groupBy(*keys, "c.position", "c.v", "c.h").agg(F.count("*").alias("n"))
    values, n_values = written(values, "cells")
    distinct = values.groupBy(*spot).agg(F.count("*").alias("_d"))
    quarters = quantiles_of(values.where("v is not null").select(*spot, "v", "n"), n_values, spot, [0.25, 0.5, 0.75])
    # a row for each column (and group) on every side
    found = found.join(distinct, spot, "left").join(quarters, spot, "left").withColumn("_d", F.coalesce("_d", F.lit(0)))
    found = found.withColumn("distinct", F.least("_d", F.lit(DISTINCT_CAP))).withColumn("distinct_capped", F.col("_d") > DISTINCT_CAP)
    own = ["position", "column", "kind", "count", "nulls", "distinct", "distinct_capped", "mean", "std", "min", F.col("q0").alias("q25"), F.col("q1").alias("median"), F.col("q2").alias("q75"), "max"]
    return found.select(*own, *[F.col(k).alias(g) for g, k in zip(by, keys)])


_PROFILE = "position int, column string, kind string, count long, nulls long, distinct long, distinct_capped boolean, mean double, std double, min double, q25 double, median double, q75 double, max double"


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """i, j, a, b, r: Pearson over rows where both are finite; null for fewer than two pairs or a constant."""
    names = (columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)])[:CORRELATED]
    v = df.select(*[finite(F.col(f"`{n}`").cast("double")).alias(f"_{i}") for i, n in enumerate(names)])
    aggs = []
    for i in range(len(names)):
        for j in range(i, len(names)):
            x, y = (F.when(F.col(f"_{i}").isNotNull() & F.col(f"_{j}").isNotNull(), F.col(f"_{k}")) for k in (i, j))
            spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
            r = F.when(F.count(x) >= 2, F.lit(1.0) if i == j else F.try_divide(F.covar_pop(x, y), spread))
            aggs.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), r.cast("double").alias("r")).alias(f"p{i}_{j}"))
    return v.agg(*aggs).select(F.explode(F.array(*[f"p{i}_{j}" for i in range(len(names)) for j in range(i, len(names))])).alias("p")).select("p.*")


def top_pairs(df: DataFrame, n: int = 10, columns: list[str] | None = None) -> DataFrame:
    return correlations(df, columns).where("i < j and r is not null").orderBy(F.abs("r").desc(), "i", "j").limit(n)


@dataclass
class Ols:
    names: list[str]
    coef: list[float]
    se: list[float]
    t: list[float]
    r2: float
    adj_r2: float
    rmse: float
    n: int
    dropped: int


def ols(df: DataFrame, features: list[str], target: str) -> Ols:
    """Least squares from centred moments: one aggregation, then a small solve on the driver."""
    if not features or target in features or len(set(features)) < len(features):
        raise ValueError("features must be distinct, not empty, and without the target")
    columns = [*features, target]
    p = len(features)
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    v = df.select(*[finite(c).alias(f"_{i}") for i, c in enumerate(columns)]).dropna()
    row = v.agg(F.count("*").alias("n"), *[F.avg(f"_{i}").alias(f"m{i}") for i in range(p + 1)], *[F.covar_pop(f"_{i}", f"_{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    n = row["n"]
    if n <= p + 1:
        raise ValueError("too few rows")
    cov = np.zeros((p + 1, p + 1))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] * n
    mean = np.array([row[f"m{i}"] for i in range(p + 1)])
    scale = np.sqrt(np.diag(cov)[:p])
    if (scale == 0).any() or np.linalg.cond(cov[:p, :p] / np.outer(scale, scale)) > 1e12:
        raise ValueError("singular: features are collinear or constant")
    inverse = np.linalg.inv(cov[:p, :p])
    slope = inverse @ cov[:p, p]
    sst = cov[p, p]
    ssr = max(0.0, sst - slope @ cov[:p, p])
    s2 = ssr / (n - p - 1)
    se = [math.sqrt(s2 * (1 / n + mean[:p] @ inverse @ mean[:p])), *np.sqrt(s2 * np.diag(inverse))]
    coef = [mean[p] - slope @ mean[:p], *slope]
    r2 = 1 - ssr / sst if sst else 0.0
    return Ols(["intercept", *features], [float(c) for c in coef], [float(s) for s in se], [float(c / s) if s else math.nan for c, s in zip(coef, se)], float(r2), float(1 - (1 - r2) * (n - 1) / (n - p - 1)), math.sqrt(ssr / n), n, df.count() - n)


def ols_frame(spark, fit: Ols) -> DataFrame:
    rows = [(n, c, s, t, fit.r2, fit.adj_r2, fit.rmse, fit.n, fit.dropped) for n, c, s, t in zip(fit.names, fit.coef, fit.se, fit.t)]
    return spark.createDataFrame(rows, "term string, coef double, se double, t double, r2 double, adj_r2 double, rmse double, n long, dropped long")


def ols_groups(df: DataFrame, x: str, y: str, groups: list[str]) -> DataFrame:
    """Simple regressions of all groups in one job; error where a group has too few rows or a constant x."""
    v = df.select(*groups, finite(x).alias("x"), finite(y).alias("y")).where("x is not null and y is not null")
    for g in groups:
        v = v.where(F.col(g).isNotNull())
    m = v.groupBy(*groups).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("cxy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    slope = F.when(F.col("n") > 2, F.try_divide("cxy", "vx"))
    return m.select(*groups, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.try_divide(F.col("cxy") * F.col("cxy"), F.col("vx") * F.col("vy")).alias("r2"), F.when(F.col("n") <= 2, F.lit("too_few_rows")).when(F.col("vx") == 0, F.lit("singular")).alias("error"))


def sample_points(df: DataFrame, columns: list[str], most: int = 2000) -> DataFrame:
    """About one row in so many that ``most`` to twice as many are left; what a scatter plot of a fit shows.

    Rows are drawn by a hash of their values and, among equal ones, of their number, so equal rows keep
    their share and a table that is read again, in whatever partitions, gives the same sample.
    """
    whole = df.select(*columns)
    for c in columns:
        whole = whole.where(finite(c).isNotNull())
    step = max(1, whole.count() // most)
    if step == 1:
        return whole
    cells = whole.groupBy(*columns).agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(F.col("_n") / F.lit(step) + part).cast("int")
    return cells.withColumn("_n", times).where("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*columns)
