import math

import numpy as np
import pytest

from statloom.functions import dist as D
from statloom.operators import cluster, groups, hypothesis as H, profile, series


def frame(spark, values, schema="i long, v double"):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], schema)


def test_distributions():
    assert D.t_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert D.chi2_sf(11.070498, 5) == pytest.approx(0.05, abs=1e-6)
    assert D.f_sf(3.098391, 3, 20) == pytest.approx(0.05, abs=1e-6)
    assert D.normal_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert D.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert D.gamma_q(0.5, 0.1) == pytest.approx(math.erfc(math.sqrt(0.1)), abs=1e-12)
    assert D.gamma_q(2.5, 30) < 1e-10 and D.beta_i(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-10)
    assert D.format_p(1e-9) == "<0.0001" and D.format_p(0.03125) == "0.0312"


def two(spark, a, b):
    return spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, v double")


def test_t_family(spark):
    df = two(spark, range(27, 32), range(22, 27))
    for t in ("welch_t", "student_t"):
        r = H.run_test(df, t, group="g", value="v")
        assert r.statistic == pytest.approx(5) and r.df == pytest.approx(8) and r.magnitude == "large"
    assert H.run_test(frame(spark, [1, 2, 3, 4, 5]), "one_sample_t", value="v").statistic == pytest.approx(4.242640687)
    three = spark.createDataFrame([(g, float(v)) for g, vs in zip("abc", ([1, 2, 3], [4, 5, 6], [7, 8, 9])) for v in vs], "g string, v double")
    r = H.run_test(three, "anova", group="g", value="v")
    assert (r.statistic, r.df, r.df2) == (pytest.approx(27), 2, 6)
    assert len(H.posthoc(three, "g", "v", "anova")) == 3
    with pytest.raises(H.TestError):
        H.run_test(three, "welch_t", group="g", value="v")
    with pytest.raises(H.TestError):
        H.run_test(two(spark, [1, 1], [1, 1]), "welch_t", group="g", value="v")


def test_ranks_and_counts(spark):
    assert H.run_test(two(spark, [1, 2, 3], [4, 5, 6]), "mann_whitney", group="g", value="v").statistic == 0
    pairs = spark.createDataFrame([(float(x), float(y)) for x, y in zip(range(1, 6), [1, 3, 2, 5, 4])], "x double, y double")
    k = H.run_test(pairs, "kendall", x="x", y="y")
    assert k.effect == pytest.approx(0.6) and k.p == pytest.approx(0.1416, abs=1e-4)
    assert H.run_test(pairs, "spearman", x="x", y="y").effect == pytest.approx(0.8)
    assert H.binomial(15, 20, 0.5).p == pytest.approx(0.041389, abs=1e-6)
    assert H.fisher([[3, 1], [1, 3]]).p == pytest.approx(0.485714, abs=1e-6)
    c = H.chi_square([[10, 20], [20, 10]])
    assert c.statistic == pytest.approx(6.666667, abs=1e-6) and c.df == 1


def test_adjust(spark):
    p = [0.01, 0.02, 0.03, 0.04]
    assert H.adjust(p, "fdr") == pytest.approx([0.04] * 4)
    assert H.adjust(p, "by") == pytest.approx([0.04 * 25 / 12] * 4)
    assert H.adjust(p, "holm") == pytest.approx([0.04, 0.06, 0.06, 0.06])
    assert H.adjust(p, "other") == p


def test_tool_difference(spark):
    rows = [(g, base + k % 3) for g, base, n in (("A", 0.0, 10), ("B", 10.0, 10), ("C", 20.0, 10), ("D", 5.0, 2)) for k in range(n)]
    found = H.tool_difference(spark.createDataFrame(rows, "g string, v double"), "g", "v")
    assert found["excluded"] == ["D(n=2)"] and len(found["pairs"]) == 3 and found["significant"]
    same = H.tool_difference(spark.createDataFrame([(g, float(k % 5)) for g in "ABC" for k in range(10)], "g string, v double"), "g", "v")
    assert not same["pairs"] and same["pairs_note"]


def test_spc(spark):
    base = [10 + (-1) ** i * 0.5 for i in range(20)]
    base[15] = 25
    v = series.violations(series.series(frame(spark, base), "i", "v")).collect()
    assert [r["i"] for r in v if r["rule"] == "R1"] == [15] and not [r for r in v if r["rule"] == "R3"]
    stable = series.spc_limits(series.series(frame(spark, [9, 11] * 10), "i", "v")).first()
    assert stable["sigma"] == pytest.approx(2 / 1.128) and stable["n_r1"] == stable["n_r2"] == stable["n_r3"] == 0
    short = series.spc(series.series(frame(spark, [1, 2, 9]), "i", "v")).first()
    assert short["error"] == "too_few_points" and not short["r1"]


def test_decompose(spark):
    pattern = [3, -1, -2, 0]
    parts = series.decompose(series.series(frame(spark, [10 + 0.5 * i + pattern[i % 4] for i in range(40)]), "i", "v"), 4)
    rows = parts.orderBy("i").collect()
    assert [r["seasonal"] for r in rows[:4]] == pytest.approx(pattern, abs=1e-9)
    assert rows[10]["trend"] == pytest.approx(15) and rows[1]["trend"] is None and rows[2]["trend"] is not None and rows[38]["trend"] is None
    s = series.strengths(parts).first()
    assert s["trend_strength"] == pytest.approx(1) and s["seasonal_strength"] == pytest.approx(1)
    few = series.decompose(series.series(frame(spark, [1, 2, 3]), "i", "v"), 4).first()
    assert few["error"] == "too_few_points" and few["trend"] is None


def test_regression_and_profile(spark):
    df = spark.createDataFrame([(float(x), 3 + 2.0 * x, None if x == 4 else float(x * x), "t") for x in range(20)], "x double, y double, z double, t string")
    fit = profile.ols(df, ["x"], "y")
    assert fit.coef == pytest.approx([3, 2]) and fit.r2 == pytest.approx(1)
    with pytest.raises(ValueError):
        profile.ols(df.selectExpr("x", "2 * x as w", "y"), ["x", "w"], "y")
    rng = np.random.default_rng(0)
    a, b, e = rng.random((3, 200))
    y = 1 + 2 * a - 3 * b + 0.1 * e
    got = profile.ols(spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, y)], "a double, b double, y double"), ["a", "b"], "y")
    design = np.column_stack([np.ones(200), a, b])
    want, ssr, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert got.coef == pytest.approx(list(want)) and got.rmse == pytest.approx(math.sqrt(ssr[0] / 200))
    assert got.se == pytest.approx(list(np.sqrt(ssr[0] / 197 * np.diag(np.linalg.inv(design.T @ design)))))
    p = {r["column"]: r for r in profile.profile(df).collect()}
    assert p["z"]["nulls"] == 1 and p["t"]["kind"] == "text" and p["x"]["median"] == 9.5 and p["t"]["distinct"] == 1
    odd = profile.profile(spark.createDataFrame([(1, 2, 3)], "P int, q int, r int").toDF("P", "p", "p"))
    assert [r["column"] for r in odd.orderBy("position").collect()] == ["P", "p", "p"]
    assert profile.correlations(df.selectExpr("x", "1.0D as c")).where("a <> b").first()["r"] is None


def test_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(float(c * 10 + rng.normal()), float(c * -10 + rng.normal())) for c in range(3) for _ in range(20)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "f1 double, f2 double")
    curve, best = cluster.elbow(df, ["f1", "f2"])
    assert best == 3 and curve[0][1] == pytest.approx(120)
    model = cluster.kmeans(df, ["f1", "f2"], 3)
    assert model.dropped == 1 and sorted(r["count"] for r in cluster.assign(df, ["f1", "f2"], model).groupBy("cluster").count().collect()) == [20, 20, 20]


def test_groups_and_trace(spark):
    rows = [(t, i, float(i % 3)) for t in "AB" for i in range(20)] + [("C", i, 1.0) for i in range(5)] + [(None, 1, 1.0)]
    df = spark.createDataFrame(rows, "tool string, lot int, v double")
    got, total = groups.for_each(df, ["tool"], "spc", x="lot", y="v")
    assert total == 3 and {r["tool"]: r["error"] for r in got.collect()} == {"A": None, "B": None, "C": "too_few_points"}
    many = spark.createDataFrame([(f"T{i:02d}", x, 1.0) for i in range(20) for x in range(9)], "t string, x int, v double")
    got, total = groups.for_each(many, ["t"], "spc", x="x", y="v")
    assert total == 20 and got.select("t").distinct().count() == 12
    frames = {"m1": spark.createDataFrame([("L1_a", 1), ("L2", 2)], "LOT_ID string, v int"), "m2": spark.createDataFrame([("L1_a", 3), ("L1xa", 4)], "lot_id string, v int"), "t": spark.createDataFrame([("x",)], "tool string")}
    rows, searched = groups.lot_trace(frames, "lot_id", "L1_a")
    assert searched == 2 and rows.count() == 2
    assert groups.lot_trace(frames, "lot_id", "1_", partial=True)[0].count() == 2
    assert groups.lot_trace(frames, "lot_id", "%", partial=True)[0].count() == 0


def test_exact_tails_of_large_counts():
    import fractions
    from math import comb

    for k, n in ((0, 5), (3, 40), (17, 60), (60, 60)):
        pmf = [fractions.Fraction(comb(n, x)) * fractions.Fraction(3, 10) ** x * fractions.Fraction(7, 10) ** (n - x) for x in range(n + 1)]
        assert H.binomial(k, n, 0.3).p == pytest.approx(float(sum(q for q in pmf if q <= pmf[k] * (1 + fractions.Fraction(1, 10**7)))), rel=1e-9)
    assert H.binomial(500_000_000, 1_000_000_000, 0.5).p == pytest.approx(1, abs=1e-6)
    assert H.fisher([[500_000, 500_500], [499_500, 500_000]]).p == pytest.approx(H.chi_square([[500_000, 500_500], [499_500, 500_000]]).p, abs=2e-2)


def test_kendall_with_ties(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 200), rng.integers(0, 6, 200)
    s = sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i in range(200) for j in range(i))
    tx, ty = (sum(n * (n - 1) / 2 for n in np.unique(v, return_counts=True)[1]) for v in (a, b))
    r = H.kendall(spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "x double, y double"), "x", "y")
    assert r.effect == pytest.approx(s / math.sqrt((19900 - tx) * (19900 - ty)))


def test_running_quantiles(spark):
    from statloom.operators import running

    rng = np.random.default_rng(4)
    groups_ = {g: np.round(rng.normal(size=n), d) for g, n, d in (("a", 1000, 1), ("b", 7, 3), ("c", 1, 2), ("d", 400, 9))}
    rows = [(g, float(v), int(n)) for g, vs in groups_.items() for v, n in zip(*np.unique(vs, return_counts=True))]
    values = spark.createDataFrame(rows, "g string, v double, n long")
    for r in running.quantiles(values, ["g"], [0.0, 0.25, 0.5, 0.75, 1.0]).collect():
        assert list(r)[1:] == pytest.approx(np.quantile(groups_[r["g"]], [0, 0.25, 0.5, 0.75, 1]).tolist())
    every = values.groupBy("v").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    flat = np.concatenate(list(groups_.values()))
    for r in running.running_counts(every).collect():
        assert r["before"] == (flat < r["v"]).sum()


def test_result_of_a_run(spark):
    three = spark.createDataFrame([(g, float(v)) for g, vs in zip("abc", ([1, 2, 3, 4], [14, 15, 16, 18], [27, 28, 29, 31])) for v in vs], "g string, v double")
    for t in ("anova", "kruskal"):
        r = H.run_test(three, t, group="g", value="v", correction="bh")
        assert len(r.posthoc) == 3 and r.correction == "bh" and r.posthoc_note is None and all(p["p_adjusted"] >= p["p"] for p in r.posthoc)
    flat = spark.createDataFrame([(g, float(v)) for g in "abc" for v in (1, 2, 3, 4)], "g string, v double")
    r = H.run_test(flat, "anova", group="g", value="v")
    assert r.posthoc == [] and r.posthoc_note
    r = H.run_test(two(spark, range(27, 32), range(22, 27)), "welch_t", group="g", value="v")
    assert 0.9 < r.power <= 1 and r.p_text == "0.0011"


def test_advice_has_its_grounds(spark):
    df = two(spark, range(27, 39), range(22, 34))
    a = H.advise(df, "groups", group="g", value="v")
    assert a["intent"] and a["primary"] == "welch_t" and [s["n"] for s in a["group_summaries"]] == [12, 12]
    assert {c["name"] for c in a["assumptions"]} == {"normality of residuals", "equal variances"} and all(c["passed"] for c in a["assumptions"])


def test_profile_of_mixed_columns(spark):
    df = spark.createDataFrame([(1.0, "a", True), (float("nan"), None, None), (3.0, "b", False), (None, "a", True)], "x double, t string, f boolean")
    rows = {r["column"]: r for r in profile.profile(df).collect()}
    assert (rows["x"]["count"], rows["x"]["nulls"], rows["x"]["distinct"], rows["x"]["median"]) == (3, 1, 3, 2.0)
    assert rows["t"]["distinct"] == 2 and rows["t"]["median"] is None and rows["f"]["mean"] == pytest.approx(2 / 3)
