"""Hypothesis tests: Spark aggregates sufficient statistics, a few lines of Python finish them.

Rank tests first aggregate to distinct values; their average ranks come from running counts
within buckets of values, so no window runs over raw rows, nor over all distinct values at once.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dist as D
from ..types import finite
from ..storage import written
from .concordance import falling_pairs, tie_sums
from .running import quantiles, running_counts

#: Groups and categories at most.
MOST_GROUPS = 50
#: Rows up to which the advice names Kendall's tau.
KENDALL_ROWS = 10_000


class TestError(ValueError):
    """The data do not allow the test."""

    __test__ = False


@dataclass
class TestResult:
    __test__ = False
    test: str
    statistic: float
    p: float
    df: float | None = None
    df2: float | None = None
    effect_name: str | None = None
    effect: float | None = None
    estimate: float | None = None
    ci_low: float | None = None
    ci_high: float | None = None
    n: int = 0
    warnings: list[str] = field(default_factory=list)
    #: What a run adds: pairs after a significant overall test, or why there are none; correction and approximate power.
    posthoc: list[dict] = field(default_factory=list)
    posthoc_note: str | None = None
    correction: str = "none"
    power: float | None = None

    @property
    def p_text(self) -> str:
        return D.format_p(self.p)

    @property
    def magnitude(self) -> str | None:
        return magnitude(self.effect_name, self.effect)


#: Least small, medium and large effect.
_SIZES = {"d": (0.2, 0.5, 0.8), "r": (0.1, 0.3, 0.5), "eta2": (0.01, 0.06, 0.14)}
_FAMILY = {"cohen_d": "d", "hedges_g": "d", "cohen_dz": "d", "cohen_h": "d", "r": "r", "rho": "r", "tau": "r", "cramer_v": "r", "rank_biserial": "r", "eta2": "eta2", "epsilon2": "eta2"}


def magnitude(name: str | None, effect: float | None) -> str | None:
    if name not in _FAMILY or effect is None or math.isnan(effect):
        return None
    return ("negligible", "small", "medium", "large")[sum(abs(effect) >= s for s in _SIZES[_FAMILY[name]])]


def result_frame(spark: SparkSession, r: TestResult) -> DataFrame:
    row = asdict(r) | {"warnings": "; ".join(r.warnings), "magnitude": r.magnitude}
    for k in ("posthoc", "posthoc_note", "correction", "power"):
        del row[k]
    row = {k: float(v) if v is not None and k in ("statistic", "p", "df", "df2", "effect", "estimate", "ci_low", "ci_high") else v for k, v in row.items()}
    return spark.createDataFrame([tuple(row.values())], "test string, statistic double, p double, df double, df2 double, effect_name string, effect double, estimate double, ci_low double, ci_high double, n long, warnings string, magnitude string")


# --- aggregates ---------------------------------------------------------------


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """label, n, mean, var, low, high of each group, by label."""
    v = df.select(F.col(group).cast("string").alias("label"), finite(value).alias("v")).where("label is not null and v is not null")
    return v.groupBy("label").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("var"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("label")


def _groups(df: DataFrame, group: str, value: str) -> list:
    rows = group_moments(df, group, value).limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise TestError(f"more than {MOST_GROUPS} groups")
    return rows


def pair_moments(df: DataFrame, x: str, y: str) -> DataFrame:
    v = df.select(finite(x).alias("x"), finite(y).alias("y")).where("x is not null and y is not null")
    return v.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("cxy"), F.avg(F.col("x") - F.col("y")).alias("md"), F.var_samp(F.col("x") - F.col("y")).alias("vd"))


def tie_ranks(values: DataFrame, by: list[str] = (), at_most: int | None = None) -> DataFrame:
    """v, n, [by]..., rank, ties: values has a row for each distinct v with its count n; the rank is the average one."""
    ranked = running_counts(values, by, at_most=at_most).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    return ranked.withColumn("ties", F.pow("n", F.lit(3)) - F.col("n")).drop("before")


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """label, n, rank_sum, total, ties for each group."""
    v = df.select(F.col(group).cast("string").alias("label"), finite(value).alias("v")).where("label is not null and v is not null")
    cells, n_cells = written(v.groupBy("v", "label").agg(F.count("*").alias("c")), "cells")
    ranked = tie_ranks(cells.groupBy("v").agg(F.sum("c").alias("n")), at_most=n_cells)
    total = ranked.agg(F.sum("n").alias("total"), F.sum("ties").alias("ties"))
    sums = cells.join(ranked.select("v", "rank"), "v").groupBy("label").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("rank_sum"))
    return sums.crossJoin(F.broadcast(total)).orderBy("label")  # one row


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    return df.select(F.col(row).cast("string").alias("r"), F.col(column).cast("string").alias("c")).where("r is not null and c is not null").groupBy("r", "c").agg(F.count("*").alias("n"))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value")


# --- t family -------------------------------------------------------------------


def _interval(centre: float, se: float, df: float, alpha: float) -> tuple[float, float]:
    half = D.t_ppf(1 - alpha / 2, df) * se
    return centre - half, centre + half


def one_sample_t(n: int, mean: float, var: float, mu0: float, alpha: float = 0.05) -> TestResult:
    if n < 2 or not var:
        raise TestError("needs two values that differ")
    se = math.sqrt(var / n)
    t = (mean - mu0) / se
    low, high = _interval(mean, se, n - 1, alpha)
    return TestResult("one_sample_t", t, D.t_sf2(t, n - 1), n - 1, None, "cohen_d", (mean - mu0) / math.sqrt(var), mean, low, high, n, ["small sample"] if n < 15 else [])


def two_sample_t(a, b, pooled: bool = False, alpha: float = 0.05) -> TestResult:
    """a, b: (n, mean, var)."""
    (n1, m1, v1), (n2, m2, v2) = a, b
    if min(n1, n2) < 2 or v1 + v2 == 0:
        raise TestError("needs two values in each group, and some spread")
    common = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    if pooled:
        se, df = math.sqrt(common * (1 / n1 + 1 / n2)), float(n1 + n2 - 2)
    else:
        u, w = v1 / n1, v2 / n2
        se, df = math.sqrt(u + w), (u + w) ** 2 / (u * u / (n1 - 1) + w * w / (n2 - 1))
    t = (m1 - m2) / se
    low, high = _interval(m1 - m2, se, df, alpha)
    warnings = []
    if pooled and (min(v1, v2) == 0 or max(v1, v2) / min(v1, v2) > 3):
        warnings.append("variances differ")
    g = (m1 - m2) / math.sqrt(common) * (1 - 3 / (4 * (n1 + n2) - 9)) if common else math.nan
    return TestResult("student_t" if pooled else "welch_t", t, D.t_sf2(t, df), df, None, "hedges_g", g, m1 - m2, low, high, n1 + n2, warnings)


def paired_t(n: int, mean: float, var: float, alpha: float = 0.05) -> TestResult:
    r = one_sample_t(n, mean, var, 0.0, alpha)
    r.test, r.effect_name = "paired_t", "cohen_dz"
    return r


def anova(groups: list[tuple[int, float, float]], name: str = "anova") -> TestResult:
    if len(groups) < 2 or min(g[0] for g in groups) < 2:
        raise TestError("needs two groups of two values")
    n, k = sum(g[0] for g in groups), len(groups)
    grand = sum(g[0] * g[1] for g in groups) / n
    between = sum(g[0] * (g[1] - grand) ** 2 for g in groups)
    within = sum((g[0] - 1) * g[2] for g in groups)
    if within == 0:
        raise TestError("no spread within groups")
    f = between / (k - 1) / (within / (n - k))
    return TestResult(name, f, D.f_sf(f, k - 1, n - k), k - 1, n - k, "eta2", between / (between + within), n=n)


def welch_anova(groups: list[tuple[int, float, float]]) -> TestResult:
    if len(groups) < 2 or min(g[0] for g in groups) < 2 or min(g[2] for g in groups) == 0:
        raise TestError("needs two groups of two values that differ")
    k, w = len(groups), [n / v for n, _, v in groups]
    total = sum(w)
    mean = sum(x * g[1] for x, g in zip(w, groups)) / total
    spread = sum((1 - x / total) ** 2 / (g[0] - 1) for x, g in zip(w, groups))
    f = sum(x * (g[1] - mean) ** 2 for x, g in zip(w, groups)) / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * spread)
    df2 = (k * k - 1) / (3 * spread)
    return TestResult("welch_anova", f, D.f_sf(f, k - 1, df2), k - 1, df2, "eta2", anova(groups).effect, n=sum(g[0] for g in groups))


def f_var(a, b) -> TestResult:
    (n1, _, v1), (n2, _, v2) = a, b
    if min(n1, n2) < 2 or not v1 or not v2:
        raise TestError("needs two groups of two values that differ")
    f = v1 / v2
    tail = D.f_sf(f, n1 - 1, n2 - 1)
    return TestResult("f_var", f, min(1.0, 2 * min(tail, 1 - tail)), n1 - 1, n2 - 1, "variance_ratio", f, n=n1 + n2)


def levene_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """label, n, mean, var of distances from the group's median."""
    v = df.select(F.col(group).cast("string").alias("label"), finite(value).alias("v")).where("label is not null and v is not null")
    middle = quantiles(v.groupBy("label", "v").agg(F.count("*").alias("n")), ["label"], [0.5]).withColumnRenamed("q0", "m")
    # a row for each group, at most MOST_GROUPS of which are used
    far = v.join(middle, "label").select("label", F.abs(F.col("v") - F.col("m")).alias("d"))
    return far.groupBy("label").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.coalesce(F.var_samp("d"), F.lit(0.0)).alias("var")).orderBy("label")


# --- rank family ------------------------------------------------------------------


def mann_whitney(sums: list) -> TestResult:
    """Two rows of rank_sums."""
    if len(sums) != 2:
        raise TestError("needs two groups")
    a, b = sums
    n1, n2, n = a["n"], b["n"], a["n"] + b["n"]
    u = a["rank_sum"] - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (n + 1 - a["ties"] / (n * (n - 1))) if n > 1 else 0
    if var <= 0:
        raise TestError("all values are equal")
    z = (u - n1 * n2 / 2) / math.sqrt(var)
    return TestResult("mann_whitney", u, 2 * D.normal_sf(abs(z)), None, None, "rank_biserial", 2 * u / (n1 * n2) - 1, z, n=n)


def kruskal(sums: list) -> TestResult:
    k, n = len(sums), sum(s["n"] for s in sums)
    if k < 2:
        raise TestError("needs two groups")
    h = 12 / (n * (n + 1)) * sum(s["rank_sum"] ** 2 / s["n"] for s in sums) - 3 * (n + 1)
    ties = 1 - sums[0]["ties"] / (n**3 - n)
    if ties <= 0:
        raise TestError("all values are equal")
    h /= ties
    return TestResult("kruskal", h, D.chi2_sf(h, k - 1), k - 1, None, "epsilon2", (h - k + 1) / (n - k) if n > k else math.nan, n=n)


def signed_ranks(differences: DataFrame) -> DataFrame:
    """n, w_plus, ties of a frame with a column d; zero differences are dropped."""
    counts = differences.where("d is not null and d <> 0").groupBy(F.abs("d").alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    return tie_ranks(counts).agg(F.sum("n").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum("ties").alias("ties"))


def wilcoxon(row, name: str = "wilcoxon") -> TestResult:
    n = row["n"] or 0
    if not n:
        raise TestError("all differences are zero")
    var = n * (n + 1) * (2 * n + 1) / 24 - row["ties"] / 48
    if var <= 0:
        raise TestError("too few differences")
    z = (row["w_plus"] - n * (n + 1) / 4) / math.sqrt(var)
    return TestResult(name, row["w_plus"], 2 * D.normal_sf(abs(z)), None, None, "r", z / math.sqrt(n), z, n=n)


# --- counts -----------------------------------------------------------------------


def table_of(cells) -> tuple[list[str], list[str], list[list[int]]]:
    rows, cols = sorted({c["r"] for c in cells}), sorted({c["c"] for c in cells})
    if len(rows) > MOST_GROUPS or len(cols) > MOST_GROUPS:
        raise TestError(f"more than {MOST_GROUPS} categories")
    at = {(c["r"], c["c"]): c["n"] for c in cells}
    return rows, cols, [[at.get((r, c), 0) for c in cols] for r in rows]


def chi_square(counts: list[list[int]]) -> TestResult:
    rows, cols = [sum(r) for r in counts], [sum(c) for c in zip(*counts)]
    n = sum(rows)
    if len(rows) < 2 or len(cols) < 2:
        raise TestError("needs two rows and two columns")
    expected = [[r * c / n for c in cols] for r in rows]
    x = sum((o - e) ** 2 / e for ro, re in zip(counts, expected) for o, e in zip(ro, re) if e)
    df = (len(rows) - 1) * (len(cols) - 1)
    v = math.sqrt(x / (n * (min(len(rows), len(cols)) - 1)))
    return TestResult("chi_square", x, D.chi2_sf(x, df), df, None, "cramer_v", v, n=n, warnings=["expected counts below 5"] if min(map(min, expected)) < 5 else [])


def _no_likelier(seen: int, low: int, high: int, mode: int, sd: float, log_p, ratio) -> float:
    """Sum of the probabilities from low to high that are no larger than that of seen.

    Only what lies within 40 standard deviations of the mode is summed, by ratios of
    neighbours: work grows with the square root of the counts.
    """
    import numpy as np

    reach = int(40 * sd) + 50
    first, last = max(low, mode - reach), min(high, mode + reach)
    if not first <= seen <= last:
        return 0.0
    x = np.arange(first, last + 1, dtype=float)
    logs = log_p(first) + np.concatenate([[0.0], np.cumsum(np.log(ratio(x[:-1])))])
    return float(np.exp(logs[logs <= logs[seen - first] + 1e-7]).sum())


def fisher(counts: list[list[int]]) -> TestResult:
    if len(counts) != 2 or len(counts[0]) != 2:
        raise TestError("needs a 2 x 2 table")
    (a, b), (c, d) = counts
    r, k, n = a + b, a + c, a + b + c + d
    low, high = max(0, k - (n - r)), min(r, k)
    log_p = lambda x: D.log_choose(r, x) + D.log_choose(n - r, k - x) - D.log_choose(n, k)
    sd = math.sqrt(r * k * (n - r) * (n - k) / (n * n * (n - 1))) if n > 1 else 0.0
    p = _no_likelier(a, low, high, min(high, max(low, (r + 1) * (k + 1) // (n + 2))), sd, log_p, lambda x: (r - x) * (k - x) / ((x + 1) * (n - r - k + x + 1)))
    odds = a * d / (b * c) if b * c else math.inf
    return TestResult("fisher", odds, min(1.0, p), None, None, "odds_ratio", odds, n=n)


def binomial(k: int, n: int, p0: float = 0.5, alpha: float = 0.05) -> TestResult:
    if not 0 < p0 < 1 or n < 1:
        raise TestError("needs a value, and p0 between 0 and 1")
    log_p = lambda x: D.log_choose(n, x) + x * math.log(p0) + (n - x) * math.log1p(-p0)
    p = _no_likelier(k, 0, n, min(n, int((n + 1) * p0)), math.sqrt(n * p0 * (1 - p0)), log_p, lambda x: (n - x) / (x + 1) * (p0 / (1 - p0)))
    share, z = k / n, D.normal_ppf(1 - alpha / 2)
    centre, half = (share + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    h = 2 * math.asin(math.sqrt(share)) - 2 * math.asin(math.sqrt(p0))
    return TestResult("binomial", k, min(1.0, p), None, None, "cohen_h", h, share, max(0.0, centre - half), min(1.0, centre + half), n, ["small sample"] if n < 20 else [])


# --- correlation --------------------------------------------------------------------


def correlation(n: int, vx: float, vy: float, cxy: float, name: str = "pearson", alpha: float = 0.05) -> TestResult:
    if n < 3 or not vx or not vy:
        raise TestError("needs three pairs, and some spread")
    r = max(-1.0, min(1.0, cxy / math.sqrt(vx * vy)))
    t = r * math.sqrt((n - 2) / (1 - r * r)) if abs(r) < 1 else math.copysign(math.inf, r)
    low = high = None
    if name == "pearson" and n > 3 and abs(r) < 1:
        z, half = math.atanh(r), D.normal_ppf(1 - alpha / 2) / math.sqrt(n - 3)
        low, high = math.tanh(z - half), math.tanh(z + half)
    return TestResult(name, t, D.t_sf2(t, n - 2), n - 2, None, "r" if name == "pearson" else "rho", r, r, low, high, n)


def rank_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y, c: average ranks of each distinct pair and its count."""
    cells = df.select(finite(x).alias("x"), finite(y).alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("c"))
    cells, n_cells = written(cells, "cells")
    for k in ("x", "y"):
        ranks = tie_ranks(cells.groupBy(F.col(k).alias("v")).agg(F.sum("c").alias("n")), at_most=n_cells).select(F.col("v").alias(k), F.col("rank").alias(f"r{k}"))
        cells = cells.join(ranks, k)
    return cells.select(F.col("rx").alias("x"), F.col("ry").alias("y"), "c")


def weighted_moments(pairs: DataFrame) -> DataFrame:
    """n, vx, vy, cxy of pairs of average ranks with counts: sums about the mean rank, (n + 1) / 2, which loses a bit or two only."""
    sums = pairs.agg(F.sum("c").alias("n"), *[F.sum(F.col("c") * F.col(a) * F.col(b)).alias(k) for k, a, b in (("vx", "x", "x"), ("vy", "y", "y"), ("cxy", "x", "y"))])
    mean = (F.col("n") + 1) / 2
    return sums.select("n", *[(F.col(k) - F.col("n") * mean * mean).alias(k) for k in ("vx", "vy", "cxy")])


def kendall(df: DataFrame, x: str, y: str, rows: int | None = None) -> TestResult:
    """Tau-b from exact counts of pairs; rows that share both values are one cell."""
    cells = df.select(finite(x).alias("x"), finite(y).alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("c"))
    cells, n_cells = written(cells, "cells")
    parts = [cells.agg(F.sum("c").alias("n")), falling_pairs(cells, n_cells, rows), tie_sums(cells.withColumnRenamed("c", "t"), "xy")]
    parts += [tie_sums(cells.groupBy(k).agg(F.sum("c").alias("t")), k) for k in ("x", "y")]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(F.broadcast(p))  # one row each
    m = one.first()
    n = m["n"] or 0
    if n < 2:
        raise TestError("needs two pairs")
    pairs2, tx, ty = n * (n - 1), int(m["x_pairs2"]), int(m["y_pairs2"])
    if pairs2 in (tx, ty):
        raise TestError("all values are equal")
    s = (pairs2 - tx - ty + int(m["xy_pairs2"]) - 4 * int(m["falling"])) // 2
    tau = 2 * s / math.sqrt((pairs2 - tx) * (pairs2 - ty))
    var = (n * (n - 1) * (2 * n + 5) - m["x_cubes"] - m["y_cubes"]) / 18 + tx * ty / (2 * n * (n - 1))
    if n > 2:
        var += m["x_triples"] * m["y_triples"] / (9 * n * (n - 1) * (n - 2))
    z = s / math.sqrt(var) if var > 0 else math.nan
    return TestResult("kendall", z, 2 * D.normal_sf(abs(z)), None, None, "tau", tau, tau, n=n)


# --- assumptions ------------------------------------------------------------------


def jarque_bera_frame(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """by, n, jb, p: null below eight values or without spread."""
    v = df.select(*by, finite(value).alias("v")).where("v is not null")
    m = v.groupBy(*by).agg(F.count("*").alias("n"), F.var_pop("v").alias("m2"), F.skewness("v").alias("s"), (F.kurtosis("v") + 3).alias("k"))
    jb = F.when((F.col("n") >= 8) & (F.col("m2") > 0), F.col("n") / 6 * (F.col("s") * F.col("s") + F.pow(F.col("k") - 3, F.lit(2)) / 4))
    return m.select(*by, "n", jb.alias("jb"), F.exp(-jb / 2).alias("p"))


def adjust(p: list[float], method: str) -> list[float]:
    """Adjusted p-values: bonferroni, holm, bh, by; anything else leaves them."""
    m, method = len(p), {"fdr": "bh", "benjamini-hochberg": "bh"}.get(method, method)
    order = sorted(range(m), key=lambda i: p[i])
    out = list(p)
    if method == "bonferroni":
        return [min(1.0, x * m) for x in p]
    if method == "holm":
        top = 0.0
        for rank, i in enumerate(order):
            top = max(top, (m - rank) * p[i])
            out[i] = min(1.0, top)
    elif method in ("bh", "by"):
        factor = sum(1 / k for k in range(1, m + 1)) if method == "by" else 1.0
        low = 1.0
        for rank in range(m - 1, -1, -1):
            low = min(low, factor * m / (rank + 1) * p[order[rank]])
            out[order[rank]] = low
    return out


def adjust_frame(df: DataFrame, p: str, key: str) -> DataFrame:
    """df with bonferroni, holm, bh and by columns, by windows."""
    by_p = Window.orderBy(p, key)
    up, down = by_p.rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.col(p).desc(), F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = df.withColumn("_m", F.count("*").over(Window.partitionBy())).withColumn("_k", F.row_number().over(by_p))
    q = q.withColumn("_h", F.sum(1 / F.col("_k")).over(Window.partitionBy()))
    one = F.lit(1.0)
    q = q.withColumn("bonferroni", F.least(one, F.col(p) * F.col("_m"))).withColumn("holm", F.least(one, F.max(F.col(p) * (F.col("_m") - F.col("_k") + 1)).over(up)))
    q = q.withColumn("bh", F.least(one, F.min(F.col(p) * F.col("_m") / F.col("_k")).over(down))).withColumn("by", F.least(one, F.min(F.col(p) * F.col("_m") * F.col("_h") / F.col("_k")).over(down)))
    return q.drop("_m", "_k", "_h")


def power(effect: float, n1: int, n2: int | None = None, alpha: float = 0.05) -> float:
    """Approximate power of a t-test of this standardised effect."""
    shift = abs(effect) * math.sqrt(n1 if n2 is None else n1 * n2 / (n1 + n2))
    z = D.normal_ppf(1 - alpha / 2)
    return D.normal_cdf(shift - z) + D.normal_cdf(-shift - z)


# --- dispatch -----------------------------------------------------------------------

MODES = {
    "groups": ("welch_t", "student_t", "mann_whitney", "f_var", "anova", "welch_anova", "kruskal", "levene"),
    "two_numeric": ("pearson", "spearman", "kendall", "paired_t", "wilcoxon"),
    "categorical": ("chi_square", "fisher"),
    "one_sample": ("one_sample_t", "wilcoxon_1s"),
    "proportion": ("binomial",),
}


def _run(df: DataFrame, test: str, *, group: str | None = None, value: str | None = None, x: str | None = None, y: str | None = None, row: str | None = None, column: str | None = None, success: str | None = None, mu0: float = 0.0, p0: float = 0.5, alpha: float = 0.05) -> TestResult:
    if test in MODES["groups"]:
        if test in ("mann_whitney", "kruskal"):
            sums = rank_sums(df, group, value).limit(MOST_GROUPS + 1).collect()
            if len(sums) > MOST_GROUPS:
                raise TestError(f"more than {MOST_GROUPS} groups")
            return (mann_whitney if test == "mann_whitney" else kruskal)(sums)
        if test == "levene":
            return anova([(r["n"], r["mean"], r["var"]) for r in levene_groups(df, group, value).collect()], "levene")
        g = [(r["n"], r["mean"], r["var"]) for r in _groups(df, group, value)]
        if test in ("welch_t", "student_t", "f_var"):
            if len(g) != 2:
                raise TestError("needs exactly two groups")
            return f_var(*g) if test == "f_var" else two_sample_t(*g, pooled=test == "student_t", alpha=alpha)
        return anova(g) if test == "anova" else welch_anova(g)
    if test in MODES["two_numeric"]:
        if test == "kendall":
            return kendall(df, x, y)
        if test == "spearman":
            m = weighted_moments(rank_pairs(df, x, y)).first()
            return correlation(m["n"] or 0, m["vx"], m["vy"], m["cxy"], "spearman", alpha)
        if test == "wilcoxon":
            return wilcoxon(signed_ranks(df.select((finite(x) - finite(y)).alias("d"))).first())
        m = pair_moments(df, x, y).first()
        return paired_t(m["n"], m["md"], m["vd"], alpha) if test == "paired_t" else correlation(m["n"], m["vx"], m["vy"], m["cxy"], "pearson", alpha)
    if test in MODES["categorical"]:
        counts = table_of(contingency(df, row, column).limit(MOST_GROUPS * MOST_GROUPS + 1).collect())[2]
        return chi_square(counts) if test == "chi_square" else fisher(counts)
    if test == "one_sample_t":
        m = df.select(finite(value).alias("v")).agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("v")).first()
        return one_sample_t(m["n"], m["m"], m["v"], mu0, alpha)
    if test == "wilcoxon_1s":
        return wilcoxon(signed_ranks(df.select((finite(value) - mu0).alias("d"))).first(), "wilcoxon_1s")
    if test == "binomial":
        m = df.select(F.col(value).cast("string").alias("v")).agg(F.count("v").alias("n"), F.count_if(F.col("v") == str(success)).alias("k")).first()
        return binomial(m["k"], m["n"], p0, alpha)
    raise TestError(f"unknown test {test}")


def run_test(df: DataFrame, test: str, *, correction: str = "none", alpha: float = 0.05, **columns) -> TestResult:
    """The test's result with approximate power (t-tests) and, after a significant overall test of three or more groups, corrected pairs."""
    alpha = alpha if 0 < alpha < 0.5 else 0.05
    r = _run(df, test, alpha=alpha, **columns)
    r.correction = {"fdr": "bh", "benjamini-hochberg": "bh"}.get(correction, correction)
    if r.correction not in ("bonferroni", "holm", "bh", "by"):
        r.correction = "none"
    if r.effect is not None and test in ("welch_t", "student_t"):
        r.power = power(r.effect, *[g["n"] for g in _groups(df, columns["group"], columns["value"])], alpha=alpha)
    elif r.effect is not None and test in ("paired_t", "one_sample_t"):
        r.power = power(r.effect, r.n, alpha=alpha)
    if test in ("anova", "welch_anova", "kruskal"):
        if r.p < alpha:
            r.posthoc = posthoc(df, columns["group"], columns["value"], test, r.correction, alpha)
        else:
            r.posthoc_note = "pairs are compared only after a significant overall test"
    return r


def pair_rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """a, b, label, n, rank_sum, ties: rank sums within each pair of groups a < b, all pairs in one job."""
    v = df.select(F.col(group).cast("string").alias("label"), finite(value).alias("v")).where("label is not null and v is not null")
    cells = v.groupBy("v", "label").agg(F.count("*").alias("c"))
    labels = cells.select(F.col("label").alias("other")).distinct()  # at most MOST_GROUPS rows
    pairs = cells.join(F.broadcast(labels), F.col("label") != F.col("other")).select(F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b"), "label", "v", "c")
    ranked = tie_ranks(pairs.groupBy("a", "b", "v").agg(F.sum("c").alias("n")), ["a", "b"]).select("a", "b", "v", "rank", "ties")
    # a tie's term once for each value, whichever group's row has it
    first = F.row_number().over(Window.partitionBy("a", "b", "v").orderBy("label")) == 1
    both = pairs.join(ranked, ["a", "b", "v"]).withColumn("ties", F.when(first, F.col("ties")).otherwise(0.0))
    sums = both.groupBy("a", "b", "label").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("rank_sum"), F.sum("ties").alias("_t"))
    return sums.withColumn("ties", F.sum("_t").over(Window.partitionBy("a", "b"))).drop("_t").orderBy("a", "b", "label")


def posthoc(df: DataFrame, group: str, value: str, test: str, correction: str = "holm", alpha: float = 0.05) -> list[dict]:
    """All pairs of three or more groups: Welch after a test of means, Mann-Whitney after kruskal."""
    rows = _groups(df, group, value)
    if len(rows) < 3:
        return []
    pairs = []
    if test == "kruskal":
        sums = pair_rank_sums(df, group, value).collect()  # two rows a pair of at most MOST_GROUPS groups
        for one, two in zip(sums[0::2], sums[1::2]):
            r = mann_whitney([one, two])
            pairs.append({"a": one["a"], "b": one["b"], "statistic": r.statistic, "p": r.p, "effect": r.effect})
    else:
        for i, a in enumerate(rows):
            for b in rows[i + 1 :]:
                r = two_sample_t(*[(g["n"], g["mean"], g["var"]) for g in (a, b)])
                pairs.append({"a": a["label"], "b": b["label"], "statistic": r.statistic, "p": r.p, "effect": r.effect, "difference": r.estimate})
    for pair, q in zip(pairs, adjust([p["p"] for p in pairs], correction)):
        pair["p_adjusted"], pair["significant"] = q, q < alpha
    return pairs


def tool_difference(df: DataFrame, group: str, value: str) -> dict:
    """Groups of three or more values compared; pairs only if the overall test is significant at 0.05."""
    rows = _groups(df, group, value)
    kept, left = [r for r in rows if r["n"] >= 3], [r for r in rows if r["n"] < 3]
    if len(kept) < 2:
        raise TestError("fewer than two groups of three values")
    g = [(r["n"], r["mean"], r["var"]) for r in kept]
    overall = two_sample_t(*g) if len(g) == 2 else welch_anova(g)
    significant = overall.p < 0.05
    pairs = posthoc(df.where(F.col(group).cast("string").isin([r["label"] for r in kept])), group, value, "welch_anova") if len(g) > 2 and significant else []
    return {
        "groups": [r.asDict() for r in kept], "excluded": [f"{r['label']}(n={r['n']})" for r in left], "test": overall, "significant": significant,
        "overall_mean": sum(n * m for n, m, _ in g) / sum(n for n, _, _ in g), "pairs": pairs, "pairs_note": None if pairs or len(g) == 2 else "pairs are compared only after a significant overall test",
    }


INTENTS = {"groups": "compare groups", "paired": "compare paired values", "two_numeric": "relate two measures", "categorical": "relate two categories", "one_sample": "compare with a value", "proportion": "compare a share with a value"}


def _normality(row, what: str) -> dict:
    """The Jarque-Bera check as an assumption; below eight values it cannot run and counts as met."""
    return {"name": f"normality of {what}", "test": "jarque_bera", "statistic": row["jb"], "p": row["p"], "passed": row["p"] is None or row["p"] >= 0.05}


def _summary(label: str, n: int, mean: float, var: float | None) -> dict:
    return {"label": label, "n": n, "mean": mean, "sd": math.sqrt(var or 0.0)}


def advise(df: DataFrame, mode: str, **columns) -> dict:
    """Which test suits the data: intent, primary, alternatives, reasons, warnings, assumptions, group_summaries, available."""
    reasons, warnings, alternatives, assumptions, summaries = [], [], [], [], []
    intent = INTENTS.get("paired" if columns.get("paired") else mode, mode)
    looks = lambda c, what: f"{what} {'look' if c['passed'] else 'do not look'} normal"
    if mode == "groups" and columns.get("paired"):
        x, y = columns["x"], columns["y"]
        m = pair_moments(df, x, y).first()
        summaries = [_summary(x, m["n"], m["mx"], m["vx"]), _summary(y, m["n"], m["my"], m["vy"])]
        check = _normality(jarque_bera_frame(df.select((finite(x) - finite(y)).alias("d")), "d").first(), "differences")
        assumptions, reasons = [check], [looks(check, "differences")]
        primary, other = ("paired_t", "wilcoxon") if check["passed"] else ("wilcoxon", "paired_t")
        alternatives = [other]
    elif mode == "groups":
        group, value = columns["group"], columns["value"]
        rows = _groups(df, group, value)
        if len(rows) < 2:
            raise TestError("needs two groups")
        summaries = [_summary(r["label"], r["n"], r["mean"], r["var"]) for r in rows]
        v = df.select(F.col(group).cast("string").alias("label"), finite(value).alias("v")).where("label is not null and v is not null")
        residual = v.join(group_moments(df, group, value).where("n > 1").select("label", "mean"), "label").select((F.col("v") - F.col("mean")).alias("e"))
        normal = _normality(jarque_bera_frame(residual, "e").first(), "residuals")
        try:
            r = _run(df, "levene", group=group, value=value)
            equal = {"name": "equal variances", "test": "levene", "statistic": r.statistic, "p": r.p, "passed": r.p >= 0.05}
        except TestError:
            equal = {"name": "equal variances", "test": "levene", "statistic": None, "p": None, "passed": False}
        assumptions = [normal, equal]
        reasons = [looks(normal, "residuals"), f"variances {'look' if equal['passed'] else 'do not look'} equal"]
        if min(r["n"] for r in rows) < 5:
            warnings.append("a group has fewer than 5 values")
        if len(rows) == 2:
            primary = "welch_t" if normal["passed"] else "mann_whitney"
            alternatives = ["mann_whitney" if normal["passed"] else "welch_t"] + (["student_t"] if equal["passed"] else [])
        else:
            primary = ("anova" if equal["passed"] else "welch_anova") if normal["passed"] else "kruskal"
            alternatives = [t for t in ("anova", "welch_anova", "kruskal") if t != primary]
    elif mode == "two_numeric":
        assumptions = [_normality(jarque_bera_frame(df, columns[c]).first(), columns[c]) for c in ("x", "y")]
        normal = all(c["passed"] for c in assumptions)
        m = pair_moments(df, columns["x"], columns["y"]).first()
        summaries = [_summary(columns["x"], m["n"], m["mx"], m["vx"]), _summary(columns["y"], m["n"], m["my"], m["vy"])]
        primary, reasons = "pearson" if normal else "spearman", [f"values {'look' if normal else 'do not look'} normal"]
        alternatives = ["spearman" if normal else "pearson"] + (["kendall"] if m["n"] <= KENDALL_ROWS else [])
    elif mode == "categorical":
        counts = table_of(contingency(df, columns["row"], columns["column"]).limit(MOST_GROUPS * MOST_GROUPS + 1).collect())[2]
        few = bool(chi_square(counts).warnings)
        square = len(counts) == 2 and len(counts[0]) == 2
        assumptions = [{"name": "expected counts of 5 or more", "test": None, "statistic": None, "p": None, "passed": not few}]
        primary, alternatives = ("fisher", ["chi_square"]) if few and square else ("chi_square", ["fisher"] if square else [])
        reasons = ["expected counts below 5"] if few else ["expected counts are large enough"]
    elif mode == "one_sample":
        check = _normality(jarque_bera_frame(df, columns["value"]).first(), columns["value"])
        m = df.select(finite(columns["value"]).alias("v")).agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s")).first()
        assumptions, summaries, reasons = [check], [_summary(columns["value"], m["n"], m["m"], m["s"])], [looks(check, "values")]
        primary, alternatives = ("one_sample_t", ["wilcoxon_1s"]) if check["passed"] else ("wilcoxon_1s", ["one_sample_t"])
    elif mode == "proportion":
        primary, reasons = "binomial", [r["value"] for r in category_counts(df, columns["value"]).limit(MOST_GROUPS).collect()]
    else:
        raise TestError(f"unknown mode {mode}")
    return {"intent": intent, "primary": primary, "alternatives": alternatives, "reasons": reasons, "warnings": warnings, "assumptions": assumptions, "group_summaries": summaries, "available": list(MODES[mode])}
