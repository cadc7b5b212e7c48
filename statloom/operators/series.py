"""Ordered series: collapse, decomposition and control charts, plain or for each group.

Rows are first aggregated to one value for each group and x, and written.  Positions come from
buckets of x, and windows run over blocks of positions with a halo (ordered.py), so neither a long
series without groups nor a long group is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written
from ..types import finite
from .ordered import add_starts, in_blocks, in_buckets

#: Mean moving range over sigma, for ranges of two.
D2 = 1.128


def series(df: DataFrame, x: str | Column, y: str | Column, groups: list[str] = (), how: str = "avg", bucket_rows: int | None = None) -> DataFrame:
    """groups, i (0, 1, ...), x, v: one value for each x, in its order; null and non-finite cells are dropped."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    rows = df.select(*groups, x.alias("x"), finite(y).alias("v"))
    if dict(rows.dtypes)["x"] in ("double", "float"):
        rows = rows.where(~F.isnan("x") & (F.abs("x") < float("inf")))
    rows = rows.where("x is not null and v is not null")
    for g in groups:
        rows = rows.where(F.col(g).isNotNull())
    rows = rows.groupBy(*groups, "x").agg((F.sum if how == "sum" else F.avg)("v").alias("v"))
    rows, n = written(rows, "series")
    cut = add_starts(in_buckets(rows, n, "x", groups, bucket_rows), n, groups, rows=bucket_rows)
    at = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy("x")) - 1
    return cut.withColumn("i", (F.col("_start") + at).cast("long")).select(*groups, "i", "x", "v")


def _with_totals(rows: DataFrame, totals: DataFrame, groups: list[str]) -> DataFrame:
    return rows.join(totals, groups) if groups else rows.crossJoin(F.broadcast(totals))  # one row


def decompose(points: DataFrame, period: int, groups: list[str] = (), multiplicative: bool = False, block: int | None = None) -> DataFrame:
    """Classical decomposition: groups, i, x, v, trend, seasonal, residual, error.

    The trend is the centred moving average over one period (half weights at the ends of an
    even one); it is null for half a period at each end.
    """
    if period < 2:
        raise ValueError("period must be at least 2")
    h, groups = period // 2, list(groups)
    frame = Window.partitionBy(*groups, "_block").orderBy("i").rowsBetween(-h, h)
    total = F.sum("v").over(frame)
    if period % 2 == 0:
        total = total - (F.first("v").over(frame) + F.last("v").over(frame)) / 2
    p = in_blocks(points, h, h, block).withColumn("trend", F.when(F.count("*").over(frame) == 2 * h + 1, total / period)).where("_own")
    rest = F.try_divide("v", "trend") if multiplicative else F.col("v") - F.col("trend")
    p = p.withColumn("phase", F.col("i") % period).withColumn("rest", rest)
    phases = p.groupBy(*groups, "phase").agg(F.coalesce(F.avg("rest"), F.lit(0.0)).alias("raw"), F.count("*").alias("n"), F.min("v").alias("low"))
    whole = phases.groupBy(*groups).agg(F.avg("raw").alias("level"), F.sum("n").alias("n"), F.min("low").alias("low"))
    raw, level = F.col("raw"), F.col("level")
    seasonal = F.when(F.abs(level) > 1e-12, raw / level).otherwise(raw) if multiplicative else raw - level
    season = _with_totals(phases.select(*groups, "phase", "raw"), whole, groups).select(*groups, "phase", seasonal.alias("seasonal"), "n", "low")
    p = p.join(season if groups else F.broadcast(season), [*groups, "phase"])  # a row for each phase
    p = p.withColumn("residual", F.try_divide("v", F.col("trend") * F.col("seasonal")) if multiplicative else F.col("v") - F.col("trend") - F.col("seasonal"))
    error = F.when(F.col("n") < 2 * period, F.lit("too_few_points"))
    if multiplicative:
        error = error.when(F.col("low") <= 0, F.lit("needs_positive_values"))
    p = p.withColumn("error", error)
    clear = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return p.select(*groups, "i", "x", "v", clear("trend"), clear("seasonal"), clear("residual"), "phase", "error")


def strengths(parts: DataFrame, groups: list[str] = (), multiplicative: bool = False) -> DataFrame:
    """groups, trend_strength, seasonal_strength, each from 0 to 1."""
    season = F.col("trend") * (F.col("seasonal") - 1) if multiplicative else F.col("seasonal")
    rest = F.col("v") - F.col("trend") * F.col("seasonal") if multiplicative else F.col("residual")
    p = parts.where("trend is not null").select(*groups, "trend", season.alias("s"), rest.alias("r"))
    found = p.groupBy(*groups).agg(F.var_pop("r").alias("r"), F.var_pop(F.col("trend") + F.col("r")).alias("tr"), F.var_pop(F.col("s") + F.col("r")).alias("sr"))

    def strength(of: str) -> Column:
        return F.when(F.col(of) < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide("r", of)))

    return found.select(*groups, strength("tr").alias("trend_strength"), strength("sr").alias("seasonal_strength"))


def seasonal_pattern(parts: DataFrame, period: int, groups: list[str] = ()) -> DataFrame:
    return parts.where(F.col("i") < period).select(*groups, "phase", "seasonal")


def spc(points: DataFrame, groups: list[str] = (), block: int | None = None) -> DataFrame:
    """I-chart: groups, i, x, v, n, center, sigma, ucl, lcl, r1, r2, r3, error.

    r1: outside three sigma; r2: ninth and later point on one side of the centre; r3: sixth
    and later point of a run that only rises or only falls.  Both runs are seen from the eight
    points before.
    """
    groups = list(groups)
    order = Window.partitionBy(*groups, "_block").orderBy("i")
    p = in_blocks(points, before=8, block=block).withColumn("pv", F.lag("v").over(order))
    step = F.avg(F.abs(F.col("v") - F.col("pv")))
    limits = p.where("_own").groupBy(*groups).agg(F.count("*").alias("n"), F.avg("v").alias("center"), (step / D2).alias("sigma"))
    p = _with_totals(p, limits, groups).withColumn("side", F.signum(F.col("v") - F.col("center"))).withColumn("dir", F.signum(F.col("v") - F.col("pv")))

    def run(c: str, length: int) -> Column:
        frame = order.rowsBetween(1 - length, 0)
        return (F.count(c).over(frame) == length) & (F.min(c).over(frame) == F.max(c).over(frame)) & (F.col(c) != 0)

    p = p.withColumn("run2", run("side", 9)).withColumn("run3", run("dir", 5)).where("_own")
    ok = F.col("n") >= 8
    p = p.withColumn("ucl", F.col("center") + 3 * F.col("sigma")).withColumn("lcl", F.col("center") - 3 * F.col("sigma"))
    return p.select(
        *groups, "i", "x", "v", "n", "center", "sigma", "ucl", "lcl",
        (ok & ((F.col("v") > F.col("ucl")) | (F.col("v") < F.col("lcl")))).alias("r1"),
        (ok & F.col("run2")).alias("r2"),
        F.coalesce(ok & F.col("run3"), F.lit(False)).alias("r3"),
        F.when(~ok, F.lit("too_few_points")).alias("error"),
    )


def spc_limits(points: DataFrame, groups: list[str] = ()) -> DataFrame:
    chart = spc(points, groups)
    return chart.groupBy(*groups).agg(*[F.max(c).alias(c) for c in ("n", "center", "sigma", "ucl", "lcl")], *[F.count_if(r).alias(f"n_{r}") for r in ("r1", "r2", "r3")], F.max("error").alias("error"))


def violations(points: DataFrame, groups: list[str] = ()) -> DataFrame:
    """groups, rule, i, x, v: all of R1, then R2, then R3."""
    rule = F.explode(F.filter(F.array(*[F.when(F.col(r), F.lit(r.upper())) for r in ("r1", "r2", "r3")]), lambda r: r.isNotNull()))
    return spc(points, groups).select(*groups, rule.alias("rule"), "i", "x", "v").orderBy(*groups, "rule", "i")
