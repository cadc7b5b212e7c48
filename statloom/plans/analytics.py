"""Charts and statistics over the given tables: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect
from ..operators import charts, cluster, groups, hypothesis, profile, series
from .tables import table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = (f, oracle)
        return f

    return add


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def hour(c: str = "ts"):
    return F.date_format(c, "yyyy-MM-dd HH")


def day(c: str = "ts"):
    return F.date_format(c, "yyyy-MM-dd")


# --- charts -------------------------------------------------------------------


@query("chart_table", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500")
def _(spark, d):
    return charts.chart(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), {"type": "table", "order": ["o_orderkey"]})


@query("chart_scatter", "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 20000")
def _(spark, d):
    return charts.scatter(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("chart_line_avg", "SELECT strftime(ts, '%Y-%m-%d') AS x, round(avg(value), 4) AS y FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(spark, d):
    return rounded(charts.aggregate(table(spark, d, "events"), day(), "value", "avg"))


@query("chart_bar_series", "SELECT l_returnflag AS x, l_linestatus AS series, round(sum(l_quantity), 2) AS y FROM lineitem GROUP BY ALL")
def _(spark, d):
    return rounded(charts.aggregate(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "sum", "l_linestatus"), 2)


@query("chart_count", "SELECT event_type AS x, count(*) AS y FROM events GROUP BY ALL")
def _(spark, d):
    return charts.aggregate(table(spark, d, "events"), "event_type", None, "count")


@query("chart_facet1", "SELECT l_linenumber::BIGINT AS x, l_returnflag AS facet1, min(l_discount) AS y FROM lineitem GROUP BY ALL")
def _(spark, d):
    return rounded(charts.aggregate(table(spark, d, "lineitem"), "l_linenumber", "l_discount", "min", None, ["l_returnflag"]))


@query("chart_facet2", "SELECT l_linenumber::BIGINT AS x, l_returnflag AS facet1, l_linestatus AS facet2, max(l_tax) AS y FROM lineitem GROUP BY ALL")
def _(spark, d):
    return rounded(charts.aggregate(table(spark, d, "lineitem"), "l_linenumber", "l_tax", "max", None, ["l_returnflag", "l_linestatus"]))


_HIST = "SELECT {by} least(floor((value - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) * 20), 19)::BIGINT AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY ALL"


@query("chart_histogram", _HIST.format(by=""))
def _(spark, d):
    return rounded(charts.histogram(table(spark, d, "events"), "value").select("bin", "n"))


@query("chart_hist_series", _HIST.format(by="event_type,"))
def _(spark, d):
    return rounded(charts.histogram(table(spark, d, "events"), "value", by=["event_type"]).select("event_type", "bin", "n"))


@query("chart_hist_range", "SELECT least(floor((value - 10) / 40 * 10), 9)::BIGINT AS bin, count(*) AS n FROM events WHERE value BETWEEN 10 AND 50 GROUP BY ALL")
def _(spark, d):
    return rounded(charts.histogram(table(spark, d, "events"), "value", 10, low=10, high=50).select("bin", "n"))


@query("wafermap", "SELECT p_size AS x, l_linenumber::BIGINT AS y, round(avg(l_quantity), 4) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def _(spark, d):
    both = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(charts.die_map(both, "p_size", "l_linenumber", "l_quantity", "none"))


@query("wafermap_count", "SELECT p_size AS x, l_linenumber::BIGINT AS y, l_returnflag AS facet1, count(*) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def _(spark, d):
    both = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(charts.die_map(both, "p_size", "l_linenumber", None, "count", ["l_returnflag"]))


@query("dash_filter", "SELECT event_type AS x, round(avg(value), 4) AS y FROM events WHERE event_type IN ('click', 'error') AND user_id IN (1, 2, 3, 4, 5) GROUP BY ALL")
def _(spark, d):
    spec = {"type": "bar", "x": "event_type", "y": "value", "agg": "avg", "filters": {"event_type": ["click", "error"], "user_id": [1, 2, 3, 4, 5], "absent": [], "other": [1]}}
    return rounded(charts.chart(table(spark, d, "events"), spec))


@query("filter_values", "SELECT value FROM (SELECT c_nationkey::VARCHAR AS value FROM customer UNION SELECT s_nationkey::VARCHAR FROM (SELECT s_nationkey FROM supplier)) WHERE value IS NOT NULL ORDER BY value LIMIT 100")
def _(spark, d):
    return charts.filter_values([table(spark, d, "customer").withColumnRenamed("c_nationkey", "k"), table(spark, d, "supplier").withColumnRenamed("s_nationkey", "k"), table(spark, d, "region")], "k")


# --- profile, correlation, regression -------------------------------------------

_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "profile_columns",
    " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS position, '{c}' AS \"column\", 'numeric' AS kind, count({c}) AS count, count(*) - count({c}) AS nulls, least(count(DISTINCT {c}), 10000) AS \"distinct\", count(DISTINCT {c}) > 10000 AS distinct_capped, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25::DOUBLE), 4) AS q25, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75::DOUBLE), 4) AS q75, round(max({c}), 4) AS max FROM lineitem"
        for i, c in enumerate(_NUMERIC)
    )
    + " UNION ALL SELECT 4, 'l_returnflag', 'text', count(l_returnflag), count(*) - count(l_returnflag), count(DISTINCT l_returnflag), false, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lineitem",
)
def _(spark, d):
    return rounded(profile.profile(table(spark, d, "lineitem").select(*_NUMERIC, "l_returnflag")))


_PAIRS = " UNION ALL ".join(f"SELECT {i}::BIGINT AS i, {j}::BIGINT AS j, '{a}' AS a, '{b}' AS b, " + ("1.0::DOUBLE AS r" if i == j else f"round(corr({a}, {b}), 4) AS r FROM lineitem") for i, a in enumerate(_NUMERIC) for j, b in enumerate(_NUMERIC) if i <= j)


@query("profile_corr", _PAIRS)
def _(spark, d):
    return rounded(profile.correlations(table(spark, d, "lineitem").select(*_NUMERIC)))


@query("top_pairs", f"SELECT a, b, r FROM ({_PAIRS}) WHERE i < j ORDER BY abs(r) DESC, i, j LIMIT 10")
def _(spark, d):
    return rounded(profile.top_pairs(table(spark, d, "lineitem").select(*_NUMERIC)).select("a", "b", "r"))


@query("ols_single", "SELECT round(regr_intercept(y, x), 4) AS intercept, round(regr_slope(y, x), 4) AS slope, round(regr_r2(y, x), 4) AS r2, count(*) AS n FROM (SELECT l_quantity AS x, 3 + 2 * l_quantity + l_extendedprice / 10000 AS y FROM lineitem)")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (3 + 2 * F.col("l_quantity") + F.col("l_extendedprice") / 10000).alias("y"))
    fit = profile.ols(rows, ["x"], "y")
    return spark.createDataFrame([(round(fit.coef[0], 4), round(fit.coef[1], 4), round(fit.r2, 4), fit.n)], "intercept double, slope double, r2 double, n long")


@query(
    "ols_multi",
    "WITH t AS (SELECT l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem), m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS bq, var_pop(y) AS yy FROM t), s AS (SELECT *, (ay * bb - bq * ab) / (aa * bb - ab * ab) AS ca, (bq * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM m) "
    "SELECT 'intercept' AS term, round(my - ca * ma - cb * mb, 2) AS coef, round(sqrt(greatest(yy - ca * ay - cb * bq, 0)), 2) AS rmse, n FROM s UNION ALL SELECT 'l_quantity', round(ca, 2), round(sqrt(yy - ca * ay - cb * bq), 2), n FROM s UNION ALL SELECT 'l_discount', round(cb, 2), round(sqrt(yy - ca * ay - cb * bq), 2), n FROM s",
)
def _(spark, d):
    return rounded(profile.ols_frame(spark, profile.ols(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")).select("term", "coef", "rmse", "n"), 2)


@query("ols_full")
def _(spark, d):
    return profile.ols_frame(spark, profile.ols(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))


@query("group_regression", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, NULL::VARCHAR AS error FROM lineitem GROUP BY ALL")
def _(spark, d):
    return rounded(groups.for_each(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "regression", x="l_quantity", y="l_extendedprice")[0].select("l_returnflag", "l_linestatus", "n", "slope", "intercept", "error"), 3)


_GROUP_PROFILE = " UNION ALL ".join(
    f"SELECT l_returnflag, l_linestatus, {i}::BIGINT AS position, '{c}' AS \"column\", count({c}) AS count, least(count(DISTINCT {c}), 10000) AS \"distinct\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25::DOUBLE), 4) AS q25, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75::DOUBLE), 4) AS q75, round(max({c}), 4) AS max, NULL::VARCHAR AS error FROM lineitem GROUP BY ALL"
    for i, c in enumerate(_NUMERIC)
)


@query("group_profile", _GROUP_PROFILE)
def _(spark, d):
    rows, _n = groups.for_each(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "profile", columns=list(_NUMERIC))
    return rounded(rows.select("l_returnflag", "l_linestatus", "position", "column", "count", "distinct", "mean", "std", "min", "q25", "median", "q75", "max", "error"))


@query("group_clusters")
def _(spark, d):
    return groups.for_each(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "cluster", features=["l_quantity", "l_extendedprice"], k=3)[0]


# --- series -----------------------------------------------------------------------


def _points(groups_: str, unit: str, how: str) -> str:
    by = f"{groups_}, " if groups_ else ""
    over = f"PARTITION BY {groups_} " if groups_ else ""
    return f"s AS (SELECT {by}x, v, row_number() OVER ({over}ORDER BY x) - 1 AS i FROM (SELECT {by}strftime(ts, '{unit}') AS x, {how}(value) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL))"


def _decompose_sql(period: int, mult: bool = False, groups_: str = "", unit: str = "%Y-%m-%d") -> str:
    by = f"{groups_}, " if groups_ else ""
    over = f"PARTITION BY {groups_} " if groups_ else ""
    h = period // 2
    frame = f"OVER ({over}ORDER BY i ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    total = f"sum(v) {frame}" if period % 2 else f"(sum(v) {frame} - (first_value(v) {frame} + last_value(v) {frame}) / 2)"
    off, on = ("/", "*") if mult else ("-", "+")
    centre = f"p.raw / q.m" if mult else "p.raw - q.m"
    match = f" AND p.{groups_} = t.{groups_}" if groups_ else ""
    matchq = f" AND q.{groups_} = t.{groups_}" if groups_ else ""
    return (
        f"WITH {_points(groups_, unit, 'sum')}, t AS (SELECT *, CASE WHEN count(*) {frame} = {2 * h + 1} THEN {total} / {period} END AS trend, i % {period} AS phase FROM s), "
        f"p AS (SELECT {by}phase, avg(v {off} trend) AS raw FROM t WHERE trend IS NOT NULL GROUP BY ALL), q AS (SELECT {by}avg(raw) AS m FROM p GROUP BY ALL) "
        f"SELECT {('t.' + groups_ + ', ') if groups_ else ''}t.i, t.x, round(trend, 4) AS trend, round({centre}, 4) AS seasonal, round(v {off} " + (f"(trend * ({centre}))" if mult else f"trend - ({centre})") + f", 4) AS residual FROM t JOIN p ON p.phase = t.phase{match} JOIN q ON true{matchq}"
    )


def _series(spark, d, by, x, how):
    return series.series(table(spark, d, "events"), x, "value", by, how)


@query("timeseries_add", _decompose_sql(7))
def _(spark, d):
    return rounded(series.decompose(_series(spark, d, [], day(), "sum"), 7).select("i", "x", "trend", "seasonal", "residual"))


@query("timeseries_add_even", _decompose_sql(4).replace(", 4)", ", 3)"))
def _(spark, d):
    return rounded(series.decompose(_series(spark, d, [], day(), "sum"), 4).select("i", "x", "trend", "seasonal", "residual"), 3)


@query("timeseries_mult", _decompose_sql(7, True))
def _(spark, d):
    return rounded(series.decompose(_series(spark, d, [], day(), "sum"), 7, [], True).select("i", "x", "trend", "seasonal", "residual"))


@query("group_timeseries", _decompose_sql(7, False, "event_type"))
def _(spark, d):
    rows, _n = groups.for_each(table(spark, d, "events").withColumn("x", day()), ["event_type"], "timeseries", x="x", y="value", period=7)
    return rounded(rows.select("event_type", "i", "x", "trend", "seasonal", "residual"))


@query("seasonal_pattern", f"SELECT i AS phase, seasonal FROM ({_decompose_sql(7)}) WHERE i < 7")
def _(spark, d):
    return rounded(series.seasonal_pattern(series.decompose(_series(spark, d, [], day(), "sum"), 7), 7))


@query(
    "strengths",
    f"WITH f AS ({_decompose_sql(7).replace('round(trend, 4)', 'trend').replace('round(p.raw - q.m, 4)', 'p.raw - q.m').replace(', 4) AS residual', ', 12) AS residual')}) SELECT round(greatest(0, 1 - var_pop(residual) / var_pop(trend + residual)), 4) AS trend_strength, round(greatest(0, 1 - var_pop(residual) / var_pop(seasonal + residual)), 4) AS seasonal_strength FROM f WHERE trend IS NOT NULL",
)
def _(spark, d):
    return rounded(series.strengths(series.decompose(_series(spark, d, [], day(), "sum"), 7)))


def _spc_sql(by: str, tail: str) -> str:
    key = f"{by}, " if by else ""
    over = f"PARTITION BY {by} " if by else ""
    return (
        f"WITH {_points(by, '%Y-%m-%d %H', 'avg')}, a AS (SELECT *, lag(v) OVER ({over}ORDER BY i) AS pv FROM s), b AS (SELECT *, count(*) OVER ({over}) AS n, avg(v) OVER ({over}) AS center, avg(abs(v - pv)) OVER ({over}) / 1.128 AS sigma FROM a), "
        f"c AS (SELECT *, sign(v - center) AS side, sign(v - pv) AS dir FROM b), e AS (SELECT *, CASE WHEN side IS NOT DISTINCT FROM lag(side) OVER ({over}ORDER BY i) THEN 0 ELSE 1 END AS sn, CASE WHEN dir IS NOT DISTINCT FROM lag(dir) OVER ({over}ORDER BY i) THEN 0 ELSE 1 END AS dn FROM c), "
        f"g AS (SELECT *, sum(sn) OVER ({over}ORDER BY i) AS si, sum(dn) OVER ({over}ORDER BY i) AS di FROM e), h AS (SELECT *, row_number() OVER (PARTITION BY {key}si ORDER BY i) AS sr, row_number() OVER (PARTITION BY {key}di ORDER BY i) AS dr FROM g), "
        f"r AS (SELECT {key}i, x, v, n, center, sigma, n >= 8 AND (v > center + 3 * sigma OR v < center - 3 * sigma) AS r1, n >= 8 AND side <> 0 AND sr >= 9 AS r2, coalesce(n >= 8 AND dir <> 0 AND dr >= 5, false) AS r3 FROM h) {tail}"
    )


@query("spc_points", _spc_sql("", "SELECT i, x, round(v, 4) AS v, round(center, 4) AS center, round(sigma, 4) AS sigma, r1, r2, r3 FROM r"))
def _(spark, d):
    return rounded(series.spc(_series(spark, d, [], hour(), "avg")).select("i", "x", "v", "center", "sigma", "r1", "r2", "r3"))


@query("group_spc", _spc_sql("event_type", "SELECT event_type, i, x, round(v, 4) AS v, round(center, 4) AS center, round(sigma, 4) AS sigma, r1, r2, r3 FROM r"))
def _(spark, d):
    rows, _n = groups.for_each(table(spark, d, "events").withColumn("x", hour()), ["event_type"], "spc", x="x", y="value")
    return rounded(rows.select("event_type", "i", "x", "v", "center", "sigma", "r1", "r2", "r3"))


@query("group2_spc", _spc_sql("event_type, u", "SELECT event_type, u, i, x, round(v, 4) AS v, r1, r2, r3 FROM r").replace("FROM events WHERE", "FROM (SELECT *, user_id % 3 AS u FROM events) WHERE"))
def _(spark, d):
    rows, _n = groups.for_each(table(spark, d, "events").withColumn("x", hour()).withColumn("u", F.col("user_id") % 3), ["event_type", "u"], "spc", x="x", y="value")
    return rounded(rows.select("event_type", "u", "i", "x", "v", "r1", "r2", "r3"))


@query("spc_limits", _spc_sql("event_type", "SELECT event_type, max(n) AS n, round(max(center), 4) AS center, round(max(sigma), 4) AS sigma, count(*) FILTER (WHERE r1) AS n_r1, count(*) FILTER (WHERE r2) AS n_r2, count(*) FILTER (WHERE r3) AS n_r3 FROM r GROUP BY event_type"))
def _(spark, d):
    return rounded(series.spc_limits(_series(spark, d, ["event_type"], hour(), "avg"), ["event_type"]).select("event_type", "n", "center", "sigma", "n_r1", "n_r2", "n_r3"))


@query("spc_violations", _spc_sql("event_type", "SELECT event_type, 'R1' AS rule, i, x FROM r WHERE r1 UNION ALL SELECT event_type, 'R2', i, x FROM r WHERE r2 UNION ALL SELECT event_type, 'R3', i, x FROM r WHERE r3"))
def _(spark, d):
    return series.violations(_series(spark, d, ["event_type"], hour(), "avg"), ["event_type"]).select("event_type", "rule", "i", "x")


# --- tests ------------------------------------------------------------------------


def two(spark, d):
    return table(spark, d, "events").where("event_type in ('click', 'error')")


def stat(spark, r: hypothesis.TestResult) -> DataFrame:
    return rounded(hypothesis.result_frame(spark, r).select("test", "statistic", "df", "df2", "effect", "n"))


_M = "WITH m AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events {w} GROUP BY 1), "
_AB = _M.format(w="WHERE event_type IN ('click', 'error')") + "a AS (SELECT * FROM m WHERE g = 'click'), b AS (SELECT n AS n2, m AS m2, v AS v2 FROM m WHERE g = 'error'), c AS (SELECT *, ((n - 1) * v + (n2 - 1) * v2) / (n + n2 - 2) AS pooled, v / n AS u, v2 / n2 AS w FROM a, b) "
_G = "(m - m2) / sqrt(pooled) * (1 - 3.0::DOUBLE / (4 * (n + n2) - 9))"


@query("welch_t_stat", _AB + f"SELECT 'welch_t' AS test, round((m - m2) / sqrt(u + w), 4) AS statistic, round((u + w) * (u + w) / (u * u / (n - 1) + w * w / (n2 - 1)), 4) AS df, NULL::DOUBLE AS df2, round({_G}, 4) AS effect, n + n2 AS n FROM c")
def _(spark, d):
    return stat(spark, hypothesis.run_test(two(spark, d), "welch_t", group="event_type", value="value"))


@query("student_t_stat", _AB + f"SELECT 'student_t' AS test, round((m - m2) / sqrt(pooled * (1.0::DOUBLE / n + 1.0::DOUBLE / n2)), 4) AS statistic, (n + n2 - 2)::DOUBLE AS df, NULL::DOUBLE AS df2, round({_G}, 4) AS effect, n + n2 AS n FROM c")
def _(spark, d):
    return stat(spark, hypothesis.run_test(two(spark, d), "student_t", group="event_type", value="value"))


@query("f_var_stat", _AB + "SELECT 'f_var' AS test, round(v / v2, 4) AS statistic, (n - 1)::DOUBLE AS df, (n2 - 1)::DOUBLE AS df2, round(v / v2, 4) AS effect, n + n2 AS n FROM c")
def _(spark, d):
    return stat(spark, hypothesis.run_test(two(spark, d), "f_var", group="event_type", value="value"))


@query("one_sample_t_stat", "SELECT 'one_sample_t' AS test, round((avg(value) - 50) / sqrt(var_samp(value) / count(*)), 4) AS statistic, (count(*) - 1)::DOUBLE AS df, NULL::DOUBLE AS df2, round((avg(value) - 50) / stddev_samp(value), 4) AS effect, count(*) AS n FROM events")
def _(spark, d):
    return stat(spark, hypothesis.run_test(table(spark, d, "events"), "one_sample_t", value="value", mu0=50))


@query("paired_t_stat", "SELECT 'paired_t' AS test, round(avg(e) / sqrt(var_samp(e) / count(*)), 4) AS statistic, (count(*) - 1)::DOUBLE AS df, NULL::DOUBLE AS df2, round(avg(e) / stddev_samp(e), 4) AS effect, count(*) AS n FROM (SELECT l_discount - l_tax AS e FROM lineitem)")
def _(spark, d):
    return stat(spark, hypothesis.run_test(table(spark, d, "lineitem"), "paired_t", x="l_discount", y="l_tax"))


_ANOVA = "k AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS grand, sum((n - 1) * v) AS within FROM m), f AS (SELECT max(k.k) AS k, max(k.n) AS n, sum(m.n * (m.m - grand) * (m.m - grand)) AS between, max(within) AS within FROM m, k) SELECT '{t}' AS test, round(between / (k - 1) / (within / (n - k)), 4) AS statistic, (k - 1)::DOUBLE AS df, (n - k)::DOUBLE AS df2, round(between / (between + within), 4) AS effect, n::BIGINT AS n FROM f"


@query("anova_stat", _M.format(w="") + _ANOVA.format(t="anova"))
def _(spark, d):
    return stat(spark, hypothesis.run_test(table(spark, d, "events"), "anova", group="event_type", value="value"))


@query("levene_stat", "WITH q AS (SELECT event_type AS g, median(value) AS med FROM events GROUP BY 1), m AS (SELECT g, count(*) AS n, avg(abs(value - med)) AS m, var_samp(abs(value - med)) AS v FROM events JOIN q ON g = event_type GROUP BY g), " + _ANOVA.format(t="levene"))
def _(spark, d):
    return stat(spark, hypothesis.run_test(table(spark, d, "events"), "levene", group="event_type", value="value"))


@query(
    "welch_anova_stat",
    _M.format(w="") + "w AS (SELECT *, n / v AS w FROM m), t AS (SELECT count(*) AS k, sum(w) AS sw, sum(w * m) / sum(w) AS mu, sum(n) AS n FROM w), l AS (SELECT max(k) AS k, max(t.n) AS n, sum((1 - w / sw) * (1 - w / sw) / (w.n - 1)) AS lam, sum(w * (m - mu) * (m - mu)) AS num FROM w, t) SELECT 'welch_anova' AS test, round(num / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lam), 4) AS statistic, (k - 1)::DOUBLE AS df, round((k * k - 1) / (3 * lam), 4) AS df2, n::BIGINT AS n FROM l",
)
def _(spark, d):
    return stat(spark, hypothesis.run_test(table(spark, d, "events"), "welch_anova", group="event_type", value="value")).drop("effect")


_RANK = "WITH z AS (SELECT event_type AS g, value AS v FROM events {w}), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS rk FROM z), tie AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM z GROUP BY v)), s AS (SELECT g, count(*)::DOUBLE AS n, sum(rk) AS rs FROM r GROUP BY g) "


@query("mann_whitney_stat", _RANK.format(w="WHERE event_type IN ('click', 'error')") + "SELECT 'mann_whitney' AS test, a.rs - a.n * (a.n + 1) / 2 AS statistic, round(2 * (a.rs - a.n * (a.n + 1) / 2) / (a.n * b.n) - 1, 4) AS effect, round((a.rs - a.n * (a.n + 1) / 2 - a.n * b.n / 2) / sqrt(a.n * b.n / 12 * (a.n + b.n + 1 - ties / ((a.n + b.n) * (a.n + b.n - 1)))), 4) AS estimate FROM s a, s b, tie WHERE a.g = 'click' AND b.g = 'error'")
def _(spark, d):
    r = hypothesis.run_test(two(spark, d), "mann_whitney", group="event_type", value="value")
    return rounded(hypothesis.result_frame(spark, r).select("test", "statistic", "effect", "estimate"))


@query("kruskal_stat", _RANK.format(w="") + "SELECT 'kruskal' AS test, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS statistic, (k - 1)::DOUBLE AS df, n::BIGINT AS n FROM (SELECT sum(n) AS n, sum(rs * rs / n) AS q, count(*) AS k FROM s), tie")
def _(spark, d):
    return stat(spark, hypothesis.run_test(table(spark, d, "events"), "kruskal", group="event_type", value="value")).select("test", "statistic", "df", "n")


@query("wilcoxon_stat", "WITH z AS (SELECT abs(d) AS v, d > 0 AS up FROM (SELECT value - 50 AS d FROM events) WHERE d <> 0), r AS (SELECT up, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS rk FROM z), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM z GROUP BY v)), s AS (SELECT count(*)::DOUBLE AS n, sum(rk) FILTER (WHERE up) AS w FROM r) SELECT 'wilcoxon_1s' AS test, w AS statistic, n::BIGINT AS n, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 4) AS estimate FROM s, t")
def _(spark, d):
    r = hypothesis.run_test(table(spark, d, "events"), "wilcoxon_1s", value="value", mu0=50)
    return rounded(hypothesis.result_frame(spark, r).select("test", "statistic", "n", "estimate"))


@query("wilcoxon_paired")
def _(spark, d):
    return hypothesis.result_frame(spark, hypothesis.run_test(table(spark, d, "lineitem"), "wilcoxon", x="l_discount", y="l_tax"))


@query("pearson_stat", "SELECT 'pearson' AS test, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS statistic, (n - 2)::DOUBLE AS df, NULL::DOUBLE AS df2, round(r, 4) AS effect, n FROM (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem)")
def _(spark, d):
    return stat(spark, hypothesis.run_test(table(spark, d, "lineitem"), "pearson", x="l_quantity", y="l_extendedprice"))


@query("spearman_stat", "SELECT 'spearman' AS test, round(corr(a, b), 4) AS effect, count(*) AS n FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)")
def _(spark, d):
    return stat(spark, hypothesis.run_test(table(spark, d, "lineitem"), "spearman", x="l_quantity", y="l_extendedprice")).select("test", "effect", "n")


@query("kendall_stat", "WITH s AS (SELECT sum(sign(a.p_size - b.p_size) * sign(a.p_retailprice - b.p_retailprice)) / 2.0::DOUBLE AS s, sum((a.p_size = b.p_size)::INT) / 2.0::DOUBLE AS tx, sum((a.p_retailprice = b.p_retailprice)::INT) / 2.0::DOUBLE AS ty, count(*) / 2.0::DOUBLE AS p FROM part a JOIN part b ON a.p_partkey <> b.p_partkey) SELECT 'kendall' AS test, round(s / sqrt((p - tx) * (p - ty)), 4) AS effect FROM s")
def _(spark, d):
    return stat(spark, hypothesis.run_test(table(spark, d, "part"), "kendall", x="p_size", y="p_retailprice")).select("test", "effect")


@query("chi_square_stat", "WITH c AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), r AS (SELECT r, sum(n) AS rn FROM c GROUP BY r), k AS (SELECT c, sum(n) AS cn FROM c GROUP BY c), t AS (SELECT sum(n) AS t FROM c), e AS (SELECT coalesce(c.n, 0) AS o, rn * cn / t AS e FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.r = r.r AND c.c = k.c), x AS (SELECT sum((o - e) * (o - e) / e) AS x FROM e) SELECT 'chi_square' AS test, round(x, 4) AS statistic, ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1)::DOUBLE AS df, NULL::DOUBLE AS df2, round(sqrt(x / (t * (least((SELECT count(*) FROM r), (SELECT count(*) FROM k)) - 1))), 4) AS effect, t::BIGINT AS n FROM x, t")
def _(spark, d):
    return stat(spark, hypothesis.run_test(table(spark, d, "orders"), "chi_square", row="o_orderstatus", column="o_orderpriority"))


@query("contingency", "SELECT quality::VARCHAR AS r, toxic::VARCHAR AS c, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return hypothesis.contingency(table(spark, d, "labels"), "quality", "toxic")


@query("category_counts", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return hypothesis.category_counts(table(spark, d, "events"), "event_type")


@query("fisher_full")
def _(spark, d):
    return hypothesis.result_frame(spark, hypothesis.run_test(table(spark, d, "labels"), "fisher", row="quality", column="toxic"))


@query("binomial_stat", "SELECT 'binomial' AS test, (sum((quality = 1)::INT))::DOUBLE AS statistic, round(avg((quality = 1)::INT), 4) AS estimate, count(*) AS n FROM labels")
def _(spark, d):
    r = hypothesis.run_test(table(spark, d, "labels"), "binomial", value="quality", success="1", p0=0.8)
    return rounded(hypothesis.result_frame(spark, r).select("test", "statistic", "estimate", "n"))


@query("tests_full")
def _(spark, d):
    e, o = table(spark, d, "events"), table(spark, d, "lineitem")
    found = [hypothesis.run_test(two(spark, d), t, group="event_type", value="value") for t in ("welch_t", "student_t", "mann_whitney", "f_var")]
    found += [hypothesis.run_test(e, t, group="event_type", value="value") for t in ("anova", "welch_anova", "kruskal", "levene")]
    found += [hypothesis.run_test(o, t, x="l_quantity", y="l_extendedprice") for t in ("pearson", "spearman")]
    out = hypothesis.result_frame(spark, found[0])
    for r in found[1:]:
        out = out.unionByName(hypothesis.result_frame(spark, r))
    return out


# --- probabilities, against SQL that integrates the densities ---------------------------

#: test -> (density, query with its statistic and degrees of freedom, column of the statistic)
_TAILS = {
    "one_sample_t": ("t", "one_sample_t_stat", "statistic"), "welch_t": ("t", "welch_t_stat", "statistic"), "student_t": ("t", "student_t_stat", "statistic"), "paired_t": ("t", "paired_t_stat", "statistic"), "pearson": ("t", "pearson_stat", "statistic"),
    "anova": ("f", "anova_stat", "statistic"), "welch_anova": ("f", "welch_anova_stat", "statistic"), "levene": ("f", "levene_stat", "statistic"), "f_var": ("f2", "f_var_stat", "statistic"),
    "chi_square": ("chi2", "chi_square_stat", "statistic"), "kruskal": ("chi2", "kruskal_stat", "statistic"), "mann_whitney": ("z", "mann_whitney_stat", "estimate"), "wilcoxon_1s": ("z", "wilcoxon_stat", "estimate"),
}


def _tails_sql() -> str:
    parts = []
    for test, (density, name, column) in _TAILS.items():
        text = QUERIES[name][1]
        for c in ("statistic", "estimate", "df", "df2"):
            text = text.replace(f", 4) AS {c}", f", 14) AS {c}")
        df = "df" if " AS df," in text else "NULL"
        df2 = "df2" if " AS df2," in text else "NULL"
        parts.append(f"SELECT '{test}' AS test, '{density}' AS density, abs({column})::DOUBLE AS x, {df}::DOUBLE AS a, {df2}::DOUBLE AS b FROM ({text})")
    # Simpson's rule from 0 to x, over the root of x for chi-square and F, whose densities may not be finite at 0
    return (
        f"WITH s AS ({' UNION ALL '.join(parts)}), u AS (SELECT *, CASE WHEN density IN ('t', 'z') THEN least(x, 60) ELSE sqrt(x) END AS top FROM s), "
        "g AS (SELECT u.*, i, top * i / 4000 AS w, CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * top / 12000 AS step FROM u, range(0, 4001) r(i)), "
        "d AS (SELECT test, density, step * CASE density WHEN 'z' THEN exp(-w * w / 2) / sqrt(2 * pi()) WHEN 't' THEN exp(lgamma((a + 1) / 2) - lgamma(a / 2) - ln(a * pi()) / 2 - (a + 1) / 2 * ln(1 + w * w / a)) "
        "WHEN 'chi2' THEN CASE WHEN w = 0 THEN 0 ELSE 2 * w * exp((a - 2) * ln(w) - w * w / 2 - a / 2 * ln(2) - lgamma(a / 2)) END "
        "ELSE CASE WHEN w = 0 THEN CASE WHEN a > 1 THEN 0 ELSE 2 * exp(lgamma((a + b) / 2) - lgamma(a / 2) - lgamma(b / 2) + a / 2 * ln(a / b)) END ELSE 2 * w * exp(lgamma((a + b) / 2) - lgamma(a / 2) - lgamma(b / 2) + a / 2 * ln(a / b) + (a - 2) * ln(w) - (a + b) / 2 * ln(1 + a * w * w / b)) END END AS area FROM g), "
        "t AS (SELECT test, density, sum(area) AS below FROM d GROUP BY ALL) "
        "SELECT test, round(greatest(0, CASE WHEN density IN ('t', 'z') THEN 1 - 2 * below WHEN density = 'f2' THEN 2 * least(below, 1 - below) ELSE 1 - below END), 5) AS p FROM t"
    )


def _tails(spark, d) -> list[hypothesis.TestResult]:
    e, item, run = table(spark, d, "events"), table(spark, d, "lineitem"), hypothesis.run_test
    found = [run(e, "one_sample_t", value="value", mu0=50), run(item, "paired_t", x="l_discount", y="l_tax"), run(item, "pearson", x="l_quantity", y="l_extendedprice"), run(e, "wilcoxon_1s", value="value", mu0=50)]
    found += [run(two(spark, d), t, group="event_type", value="value") for t in ("welch_t", "student_t", "f_var", "mann_whitney")]
    found += [run(e, t, group="event_type", value="value") for t in ("anova", "welch_anova", "levene", "kruskal")]
    return [*found, run(table(spark, d, "orders"), "chi_square", row="o_orderstatus", column="o_orderpriority")]


@query("p_values", _tails_sql())
def _(spark, d):
    return rounded(spark.createDataFrame([(r.test, float(r.p)) for r in _tails(spark, d)], "test string, p double"), 5)


@query("wilcoxon_paired_stat", QUERIES["wilcoxon_stat"][1].replace("value - 50 AS d FROM events", "l_discount - l_tax AS d FROM lineitem").replace("'wilcoxon_1s'", "'wilcoxon'"))
def _(spark, d):
    r = hypothesis.run_test(table(spark, d, "lineitem"), "wilcoxon", x="l_discount", y="l_tax")
    return rounded(hypothesis.result_frame(spark, r).select("test", "statistic", "n", "estimate"))


_FISHER = "WITH c AS (SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS a, count(*) FILTER (WHERE quality = 0) AS r, count(*) FILTER (WHERE toxic = 0) AS k, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), "


@query(
    "fisher_p",
    _FISHER + "x AS (SELECT c.*, unnest(range(greatest(0, r + k - n), least(r, k) + 1)) AS i FROM c), "
    "p AS (SELECT a, n, i, exp(lgamma(r + 1) - lgamma(i + 1) - lgamma(r - i + 1) + lgamma(n - r + 1) - lgamma(k - i + 1) - lgamma(n - r - k + i + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)) AS p FROM x) "
    "SELECT 'fisher' AS test, round(least(1, sum(p)), 6) AS p, max(n)::BIGINT AS n FROM p WHERE p <= (SELECT p * (1 + 1e-7) FROM p WHERE i = a)",
)
def _(spark, d):
    r = hypothesis.run_test(table(spark, d, "labels"), "fisher", row="quality", column="toxic")
    return rounded(spark.createDataFrame([(r.test, float(r.p), r.n)], "test string, p double, n long"), 6)


@query(
    "binomial_p",
    "WITH c AS (SELECT count(*) FILTER (WHERE quality = 1) AS k, count(*) AS n FROM labels WHERE quality IS NOT NULL), p AS (SELECT k, n, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.8::DOUBLE) + (n - i) * ln(0.2::DOUBLE)) AS p FROM (SELECT c.*, unnest(range(0, n + 1)) AS i FROM c)) "
    "SELECT 'binomial' AS test, round(least(1, sum(p)), 6) AS p, max(n)::BIGINT AS n FROM p WHERE p <= (SELECT p * (1 + 1e-7) FROM p WHERE i = k)",
)
def _(spark, d):
    r = hypothesis.run_test(table(spark, d, "labels"), "binomial", value="quality", success="1", p0=0.8)
    return rounded(spark.createDataFrame([(r.test, float(r.p), r.n)], "test string, p double, n long"), 6)


@query(
    "intervals",
    "WITH q AS (SELECT 1.959963984540054::DOUBLE AS z), r AS (SELECT corr(l_quantity, l_tax) AS r, count(*) AS n FROM lineitem), b AS (SELECT avg((quality = 1)::INT)::DOUBLE AS p, count(*)::DOUBLE AS n FROM labels WHERE quality IS NOT NULL) "
    "SELECT 'pearson' AS test, round(tanh(atanh(r) - z / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + z / sqrt(n - 3)), 6) AS high FROM r, q "
    "UNION ALL SELECT 'binomial', round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6), round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) FROM b, q",
)
def _(spark, d):
    found = [hypothesis.run_test(table(spark, d, "lineitem"), "pearson", x="l_quantity", y="l_tax"), hypothesis.run_test(table(spark, d, "labels"), "binomial", value="quality", success="1", p0=0.8)]
    return rounded(spark.createDataFrame([(r.test, r.ci_low, r.ci_high) for r in found], "test string, low double, high double"), 6)


@query(
    "ols_errors",
    "WITH m AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) * count(*) AS sxx, covar_pop(l_extendedprice, l_quantity) * count(*) AS sxy, var_pop(l_extendedprice) * count(*) AS syy FROM lineitem), "
    "f AS (SELECT *, sxy / sxx AS b, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM m), t AS (SELECT 'intercept' AS term, my - b * mx AS coef, sqrt(s2 * (1 / n + mx * mx / sxx)) AS se, sxy * sxy / sxx / syy AS r2, n FROM f UNION ALL SELECT 'l_quantity', b, sqrt(s2 / sxx), sxy * sxy / sxx / syy, n FROM f) "
    "SELECT term, round(coef, 3) AS coef, round(se, 3) AS se, round(coef / se, 3) AS t, round(r2, 8) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 8) AS adj_r2 FROM t",
)
def _(spark, d):
    fit = profile.ols_frame(spark, profile.ols(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice"))
    return fit.select("term", *[F.round(c, 3).alias(c) for c in ("coef", "se", "t")], *[F.round(c, 8).alias(c) for c in ("r2", "adj_r2")])


@query("jarque_bera", "WITH m AS (SELECT event_type, count(*) AS n, avg(value) AS mu FROM events GROUP BY 1), p AS (SELECT event_type, max(n) AS n, avg(pow(value - mu, 2)) AS m2, avg(pow(value - mu, 3)) AS m3, avg(pow(value - mu, 4)) AS m4 FROM events JOIN m USING (event_type) GROUP BY 1), j AS (SELECT event_type, n, n / 6 * (pow(m3 / pow(m2, 1.5::DOUBLE), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM p) SELECT event_type, n, round(jb, 4) AS jb, round(exp(-jb / 2), 4) AS p FROM j")
def _(spark, d):
    return rounded(hypothesis.jarque_bera_frame(table(spark, d, "events"), "value", ["event_type"]))


@query("group_moments", "SELECT event_type AS label, count(*) AS n, round(avg(value), 4) AS mean, round(var_samp(value), 4) AS var, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def _(spark, d):
    return rounded(hypothesis.group_moments(table(spark, d, "events"), "event_type", "value"))


_P = "(SELECT n_nationkey AS k, (n_nationkey * 7 % 25 + 1) / 400.0::DOUBLE AS p FROM nation)"


@query("padjust", f"WITH t AS (SELECT k, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, k) AS i FROM {_P}), h AS (SELECT sum(1.0::DOUBLE / i) AS h FROM t) SELECT k, round(p, 6) AS p, round(least(1, p * m), 6) AS bonferroni, round(least(1, max(p * (m - i + 1)) OVER (ORDER BY i)), 6) AS holm, round(least(1, min(p * m / i) OVER (ORDER BY i DESC)), 6) AS bh, round(least(1, min(p * m * h / i) OVER (ORDER BY i DESC)), 6) AS by FROM t, h")
def _(spark, d):
    p = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), ((F.col("n_nationkey") * 7 % 25 + 1) / 400).alias("p"))
    return rounded(hypothesis.adjust_frame(p, "p", "k"), 6)


@query("tooldiff_groups", "SELECT event_type AS label, count(*) AS n, round(avg(value), 4) AS mean, round(var_samp(value), 4) AS var FROM events GROUP BY 1 HAVING count(*) >= 3")
def _(spark, d):
    found = hypothesis.tool_difference(table(spark, d, "events"), "event_type", "value")
    return rounded(spark.createDataFrame([(g["label"], g["n"], g["mean"], g["var"]) for g in found["groups"]], "label string, n long, mean double, var double"))


@query("tooldiff_pairs_stat", _M.format(w="") + "c AS (SELECT a.g AS a, b.g AS b, a.m - b.m AS diff, a.v / a.n AS u, b.v / b.n AS w FROM m a JOIN m b ON a.g < b.g) SELECT a, b, round(diff, 4) AS difference, round(diff / sqrt(u + w), 4) AS statistic FROM c")
def _(spark, d):
    pairs = hypothesis.posthoc(table(spark, d, "events"), "event_type", "value", "welch_anova")
    return rounded(spark.createDataFrame([(p["a"], p["b"], p["difference"], p["statistic"]) for p in pairs], "a string, b string, difference double, statistic double"))


@query("advise")
def _(spark, d):
    e, o = table(spark, d, "events"), table(spark, d, "lineitem")
    asked = [("groups", e, {"group": "event_type", "value": "value"}), ("groups", two(spark, d), {"group": "event_type", "value": "value"}), ("two_numeric", o, {"x": "l_quantity", "y": "l_tax"}), ("categorical", table(spark, d, "labels"), {"row": "quality", "column": "toxic"}), ("one_sample", e, {"value": "value"}), ("proportion", e, {"value": "event_type"})]
    rows = [(mode, a["primary"], ",".join(a["alternatives"]), "; ".join(a["reasons"])) for mode, df, c in asked for a in [hypothesis.advise(df, mode, **c)]]
    return spark.createDataFrame(rows, "mode string, primary string, alternatives string, reasons string")


# --- clusters and tracing --------------------------------------------------------------


DIMENSIONS = 64
FEATURES = [f"f{i}" for i in range(DIMENSIONS)]


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.element_at("embedding", i + 1).cast("double").alias(f) for i, f in enumerate(FEATURES)])


@query("kmeans")
def _(spark, d):
    v = _vectors(spark, d)
    return cluster.assign(v, FEATURES, cluster.kmeans(v, FEATURES, 4)).select("vec_id", "cluster")


@query("elbow")
def _(spark, d):
    curve, best = cluster.elbow(_vectors(spark, d), FEATURES, 6)
    return spark.createDataFrame([(k, v, k == best) for k, v in curve], "k int, inertia double, best boolean")


@query(
    "nearest_centroid",
    "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY ALL), "
    "d AS (SELECT vec_id, c.label, sum((v - m) * (v - m)) AS d FROM e JOIN c USING (i) GROUP BY vec_id, c.label), n AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT label FROM embeddings)) "
    "SELECT vec_id, arg_min(k, d)::BIGINT AS cluster FROM d JOIN n USING (label) GROUP BY vec_id",
)
def _(spark, d):
    import numpy as np

    v = _vectors(spark, d)
    centres = v.groupBy("label").agg(*[F.avg(f).alias(f) for f in FEATURES]).orderBy("label").select(*FEATURES).collect()  # a row for each label
    model = cluster.KMeans(np.array([tuple(r) for r in centres]), np.zeros(DIMENSIONS), np.ones(DIMENSIONS), 0.0, 0, 0)
    return rounded(cluster.assign(v, FEATURES, model).select("vec_id", "cluster"))


@query(
    "text_dates",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %j') AS d, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS m, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 2440587.5::DOUBLE AS j, epoch(o_orderdate::DATE + INTERVAL 10 DAY)::BIGINT AS e, o_orderpriority GLOB '[1-3]-*' AS g FROM orders",
)
def _(spark, d):
    dialect.create(spark)
    day = F.col("o_orderdate").cast("date").cast("string")
    table(spark, d, "orders").select("o_orderkey", "o_orderpriority", day.alias("day")).createOrReplaceTempView("dated")
    return spark.sql("SELECT o_orderkey, strftime('%Y/%m/%d %j', day) AS d, datetime(day, 'start of month') AS m, julianday(day) AS j, unixepoch(day, '+10 days') AS e, glob('[1-3]-*', o_orderpriority) AS g FROM dated")


@query("chart_raw", "SELECT l_orderkey AS x, l_quantity AS y, l_returnflag AS series FROM lineitem ORDER BY ALL LIMIT 20000")
def _(spark, d):
    return charts.chart(table(spark, d, "lineitem"), {"type": "line", "x": "l_orderkey", "y": "l_quantity", "agg": "none", "series": "l_returnflag"})


@query("chart_bar_capped", "WITH f AS (SELECT DISTINCT l_orderkey AS x FROM lineitem WHERE l_quantity IS NOT NULL ORDER BY x LIMIT 60), b AS (SELECT l_orderkey AS x, l_quantity AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS n FROM lineitem JOIN f ON f.x = l_orderkey WHERE l_quantity IS NOT NULL) SELECT x, y FROM b WHERE n <= 3")
def _(spark, d):
    marks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("x"), F.col("l_quantity").alias("y"))
    return charts.capped_bars(marks, 60, 3)[0]


@query("posthoc_ranks", "WITH z AS (SELECT event_type AS g, value AS v FROM events), p AS (SELECT DISTINCT a.g AS a, b.g AS b FROM z a, (SELECT DISTINCT g FROM z) b WHERE a.g < b.g), r AS (SELECT a, b, g, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0::DOUBLE AS rk FROM p JOIN z ON g IN (a, b)) SELECT a, b, sum(rk) FILTER (WHERE g = a) - count(*) FILTER (WHERE g = a) * (count(*) FILTER (WHERE g = a) + 1) / 2 AS statistic FROM r GROUP BY a, b")
def _(spark, d):
    pairs = hypothesis.posthoc(table(spark, d, "events"), "event_type", "value", "kruskal")
    return spark.createDataFrame([(p["a"], p["b"], float(p["statistic"])) for p in pairs], "a string, b string, statistic double")


def _traced(spark, d):
    return {"orders": table(spark, d, "orders").select(F.col("o_orderkey").alias("KEY_ID"), "o_custkey"), "lineitem": table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key_id"), "l_linenumber", "l_partkey"), "region": table(spark, d, "region")}


@query("lottrace_exact", "SELECT 'orders' AS dataset, count(*) AS n FROM orders WHERE o_orderkey = 42 HAVING count(*) > 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey = 42 HAVING count(*) > 0")
def _(spark, d):
    return groups.lot_trace(_traced(spark, d), "key_id", "42")[0].groupBy("dataset").agg(F.count("*").alias("n"))


@query("lottrace_partial", "SELECT 'orders' AS dataset, least(count(*), 500) AS n FROM orders WHERE o_orderkey::VARCHAR LIKE '%42%' UNION ALL SELECT 'lineitem', least(count(*), 500) FROM lineitem WHERE l_orderkey::VARCHAR LIKE '%42%'")
def _(spark, d):
    return groups.lot_trace(_traced(spark, d), "key_id", "42", partial=True)[0].groupBy("dataset").agg(F.count("*").alias("n"))
