"""Order over whole tables: buckets, blocks, running counts, quantiles, series and Kendall's tau, with buckets small enough to be many."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import concordance, hypothesis, ordered, running, series
from statloom.storage import written


def values_frame(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(5)


@pytest.mark.parametrize("kind", ["double", "long", "string", "date"])
def test_buckets_follow_the_order(spark, kind):
    rng = random.Random(1)
    numbers = list({rng.randint(0, 10**6) for _ in range(3000)})
    df = values_frame(spark, numbers, "long")
    make = {"double": F.col("v") / 7, "long": F.col("v"), "string": F.concat(F.lit("é"), F.col("v").cast("string")), "date": F.date_add(F.lit("2000-01-01"), F.col("v").cast("int"))}
    df, n = written(df.select(make[kind].alias("v")), "values")
    rows = ordered.in_buckets(df, n, "v", rows=20).orderBy("v").collect()
    got = [r["_bucket"] for r in rows]
    assert got == sorted(got)
    sizes = Counter(got)
    assert len(sizes) > 70 and max(sizes.values()) < 20 * 8


def test_edges_of_their_own(spark):
    """A value of a third of all rows has a bucket of its own."""
    rows = [(float(i % 1000) if i % 3 else 500.0, i) for i in range(6000)]
    df, n = written(spark.createDataFrame(rows, "v double, k long"), "values")
    got = ordered.in_buckets(df, n, "v", ["k"], rows=100, apart=True).select("v", "_bucket").distinct().collect()
    by = defaultdict(set)
    for v, b in got:
        by[b].add(v)
    assert [len(s) for s in by.values() if 500.0 in s] == [1]
    assert all(len(s) == 1 for b, s in by.items() if b % 2)
    order = [b for _, b in sorted(got)]
    assert order == sorted(order)


@pytest.mark.parametrize("rows", [7, 100, None])
def test_running_counts_and_quantiles(spark, rows):
    rng = random.Random(2)
    data = [(rng.choice("ab"), round(rng.gauss(0, 1), 2) if rng.random() < 0.7 else 0.25) for _ in range(2000)] + [("c", 1.0)]
    counts = Counter(data)
    df = spark.createDataFrame([(g, v, n) for (g, v), n in counts.items()], "g string, v double, n long").repartition(4)
    for r in running.running_counts(df, ["g"], rows).collect():
        assert r["before"] == sum(n for (g, v), n in counts.items() if g == r["g"] and v < r["v"])
    for r in running.quantiles(df, ["g"], [0.0, 0.1, 0.5, 0.75, 1.0], rows).collect():
        want = np.quantile([v for g, v in data if g == r["g"]], [0.0, 0.1, 0.5, 0.75, 1.0])
        assert np.allclose([r[f"q{i}"] for i in range(5)], want)
    whole = df.groupBy("v").agg(F.sum("n").alias("n"))
    for r in running.running_counts(whole, rows=rows).collect():
        assert r["before"] == sum(v < r["v"] for _, v in data)


def plain_chart(values):
    """Centre, sigma and the rules of one series, from the definitions."""
    n, center = len(values), sum(values) / len(values)
    steps = [abs(b - a) for a, b in zip(values, values[1:])]
    sigma = sum(steps) / len(steps) / 1.128 if steps else None
    side, run2, run3, out = 0, 0, 0, []
    direction = None
    for i, v in enumerate(values):
        s = (v > center) - (v < center)
        run2 = run2 + 1 if i and s == side else 1
        side = s
        d = None if not i else (v > values[i - 1]) - (v < values[i - 1])
        run3 = run3 + 1 if i > 1 and d == direction else 1
        direction = d
        ok = n >= 8
        out.append((ok and (v > center + 3 * sigma or v < center - 3 * sigma), ok and s != 0 and run2 >= 9, bool(ok and d and run3 >= 5)))
    return center, sigma, out


@pytest.mark.parametrize("sizes", [(5, 9), (40, 16), (None, None)])
def test_control_chart_over_blocks(spark, sizes):
    rng = random.Random(4)
    groups = {"long": [], "flat": [], "short": [3.0, 4.0, 2.0], "steps": [float(i // 7) for i in range(90)]}
    level = 0.0
    for i in range(400):
        level += rng.choice([-1, 0, 0, 1]) if i % 50 < 40 else 1
        groups["long"].append(float(level))
        groups["flat"].append(10.0 if i % 97 else 500.0)
    rows = [(g, i * 3, v) for g, values in groups.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, x long, y double").repartition(6)
    bucket, block = sizes
    chart = series.spc(series.series(df, "x", "y", ["g"], bucket_rows=bucket), ["g"], block)
    for g, values in groups.items():
        center, sigma, want = plain_chart(values)
        got = chart.where(F.col("g") == g).orderBy("i").collect()
        assert [(r["i"], r["x"], r["v"]) for r in got] == [(i, i * 3, v) for i, v in enumerate(values)]
        assert [(r["r1"], r["r2"], r["r3"]) for r in got] == want
        assert math.isclose(got[0]["center"], center) and math.isclose(got[0]["sigma"], sigma)
    alone = series.spc(series.series(df.where("g = 'long'"), "x", "y", bucket_rows=bucket), (), block).orderBy("i").collect()
    assert [(r["r1"], r["r2"], r["r3"]) for r in alone] == plain_chart(groups["long"])[2]


def test_chart_has_no_window_over_everything(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "x long, y double")
    points = series.series(df, "x", "y", bucket_rows=8)
    for plan in (series.spc(points), series.decompose(points, 4), series.decompose(points, 7, multiplicative=True)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in text.splitlines() if "Window [" in line]
        assert windows and all("_bucket" in w or "_block" in w for w in windows)


def plain_decompose(v, period, multiplicative):
    n, h = len(v), period // 2
    trend = [None] * n
    for i in range(h, n - h):
        w = v[i - h : i + h + 1]
        trend[i] = (sum(w) if period % 2 else sum(w) - (w[0] + w[-1]) / 2) / period
    rest = [None if t is None else (a / t if multiplicative else a - t) for a, t in zip(v, trend)]
    raw = []
    for p in range(period):
        mine = [r for i, r in enumerate(rest) if i % period == p and r is not None]
        raw.append(sum(mine) / len(mine) if mine else 0.0)
    level = sum(raw) / period
    season = [r / level if multiplicative else r - level for r in raw]
    return [(t, season[i % period], None if t is None else (a / (t * season[i % period]) if multiplicative else a - t - season[i % period])) for i, (a, t) in enumerate(zip(v, trend))]


@pytest.mark.parametrize("period,multiplicative,sizes", [(4, False, (10, 4)), (7, True, (10, 11)), (12, False, (None, None))])
def test_decompose_over_blocks(spark, period, multiplicative, sizes):
    rng = random.Random(6)
    groups = {g: [50 + 0.1 * i + 5 * math.sin(2 * math.pi * i / period) + rng.random() for i in range(n)] for g, n in (("a", 150), ("b", 2 * period))}
    df = spark.createDataFrame([(g, i, v) for g, values in groups.items() for i, v in enumerate(values)], "g string, x long, y double").repartition(4)
    bucket, block = sizes
    parts = series.decompose(series.series(df, "x", "y", ["g"], bucket_rows=bucket), period, ["g"], multiplicative, block)
    for g, values in groups.items():
        got = parts.where(F.col("g") == g).orderBy("i").collect()
        for r, want in zip(got, plain_decompose(values, period, multiplicative), strict=True):
            assert all(a is None and b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip((r["trend"], r["seasonal"], r["residual"]), want))
    with pytest.raises(ValueError):
        ordered.in_blocks(df, 5, 5, block=4)


def plain_tau(rows):
    up = down = tx = ty = 0
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        tx, ty = tx + (a == c), ty + (b == d)
        s = (a - c) * (b - d)
        up, down = up + (s > 0), down + (s < 0)
    pairs = len(rows) * (len(rows) - 1) / 2
    return down, (up - down) / math.sqrt((pairs - tx) * (pairs - ty))


def test_weighted_inversions():
    rng = random.Random(7)
    for n in (1, 2, 30, 200):
        k, y, w = ([rng.randint(0, m) for _ in range(n)] for m in (9, 20, 5))
        want = sum(w[i] * w[j] for i in range(n) for j in range(n) if k[i] < k[j] and y[i] > y[j])
        assert concordance.weighted_inversions(np.array(k, float), np.array(y, float), np.array(w)) == want
    huge = np.array([1 << 40, 1 << 41, 1 << 42])
    assert concordance.weighted_inversions(np.array([1.0, 2.0, 3.0]), np.array([3.0, 2.0, 1.0]), huge) == (1 << 81) + (1 << 82) + (1 << 83)


@pytest.mark.parametrize("rows", [12, 60, None])
def test_kendall_over_buckets(spark, rows):
    rng = random.Random(8)
    pairs = [(float(rng.randint(0, 60)), float(rng.randint(0, 400))) for _ in range(300)]
    pairs += [(30.0, float(rng.randint(0, 400))) for _ in range(200)] + [(float(rng.randint(0, 60)), 77.0) for _ in range(60)]
    pairs += [(x, x * 5 + rng.randint(0, 9)) for x in map(float, range(60))] + pairs[:20]
    df = spark.createDataFrame([*pairs, (1.0, None), (None, 2.0), (float("nan"), 1.0)], "x double, y double").repartition(5)
    down, tau = plain_tau(pairs)
    cells = spark.createDataFrame([(x, y, c) for (x, y), c in Counter(pairs).items()], "x double, y double, c long")
    cells, n = written(cells, "cells")
    assert int(concordance.falling_pairs(cells, n, rows).first()["falling"]) == down
    got = hypothesis.kendall(df, "x", "y", rows)
    assert math.isclose(got.effect, tau, rel_tol=1e-12) and got.n == len(pairs)


def test_kendall_refuses(spark):
    for rows, why in (([(1.0, 2.0)], "two pairs"), ([(1.0, 2.0), (1.0, 3.0)], "equal")):
        with pytest.raises(hypothesis.TestError, match=why):
            hypothesis.kendall(spark.createDataFrame(rows, "x double, y double"), "x", "y")
