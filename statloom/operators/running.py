"""Running counts and exact quantiles over distinct values, in buckets of values (see ordered.py).

The distinct values are written once; all that follows reads that table, whose size sets the
number of buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written
from .ordered import ROWS, add_starts, in_buckets


def _counted(values: DataFrame, n: int, by: list[str], rows: int | None) -> DataFrame:
    cut = add_starts(in_buckets(values, n, "v", by, rows), n, by, "n", rows)
    order = Window.partitionBy(*by, "_bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)) + F.col("_start")).drop("_bucket", "_start")


def _known(values: DataFrame, at_most: int | None, rows: int | None) -> tuple[DataFrame, int]:
    """values that may be read often, and how many: written, unless so few are possible that one bucket takes them."""
    if at_most is not None and at_most <= (rows or ROWS):
        return values, at_most
    return written(values, "values")


def running_counts(values: DataFrame, by: list[str] = (), rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """values (by, v, n; each v once for each by) with ``before``, the sum of n of lesser v."""
    return _counted(*_known(values, at_most, rows), list(by), rows)


def quantiles(values: DataFrame, by: list[str], probabilities: list[float], rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """by, q0, q1, ...: exact linearly interpolated quantiles of values (by, v, n)."""
    return quantiles_of(*_known(values, at_most, rows), by, probabilities, rows)


def quantiles_of(values: DataFrame, n: int, by: list[str], probabilities: list[float], rows: int | None = None) -> DataFrame:
    """The same of a table of n rows that gives the same rows whenever it is read."""
    totals = values.groupBy(*by).agg(F.sum("n").alias("_all"))
    run = _counted(values, n, by, rows)
    run = run.join(totals, by) if by else run.crossJoin(F.broadcast(totals))

    def at(place):
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("v")))

    out = []
    for i, q in enumerate(probabilities):
        place = (F.col("_all") - 1) * F.lit(float(q))
        out += [at(F.floor(place)).alias(f"_a{i}"), at(F.ceil(place)).alias(f"_b{i}"), F.max(place - F.floor(place)).alias(f"_f{i}")]
    found = run.groupBy(*by).agg(*out)
    return found.select(*by, *[(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias(f"q{i}") for i in range(len(probabilities))])
