"""Chart data: grouped series, facets, histograms, die maps, filters."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": lambda c: F.count("*")}


def dashboard_filter(df: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """Rows that match one chosen value in each filtered column; empty choices filter nothing."""
    for c, values in chosen.items():
        if values and c in df.columns:
            df = df.where(F.col(c).isin(list(values)))
    return df


def filter_values(frames: list[DataFrame], column: str, most: int = 100) -> DataFrame:
    """The distinct non-null values of a column over all frames that have it, in order; a limited list of choices."""
    own = [f.select(F.col(column).cast("string").alias("value")) for f in frames if column.lower() in [c.lower() for c in f.columns]]
    if not own:
        raise ValueError(f"no dataset has a column {column}")
    out = own[0]
    for f in own[1:]:
        out = out.unionByName(f)
    return out.where("value is not null").distinct().orderBy("value").limit(most)


def aggregate(df: DataFrame, x: str | Column, y: str | None, agg: str = "avg", series: str | None = None, facets: list[str] = ()) -> DataFrame:
    """x, [series], [facets], y: one row for each mark of a line or bar chart."""
    if agg == "none":
        return raw_points(df, x, y, series, facets)
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg}")
    x = F.col(x) if isinstance(x, str) else x
    by = [x.alias("x"), *([F.col(series).alias("series")] if series else []), *[F.col(c).alias(f"facet{i}") for i, c in enumerate(facets, 1)]]
    names = ["x", *(["series"] if series else []), *[f"facet{i}" for i in range(1, len(facets) + 1)]]
    value = F.col(y) if y else F.lit(1)
    marks = df.where(x.isNotNull())
    if y and agg != "count":
        marks = marks.where(value.isNotNull())
    return marks.select(*by, value.alias("_y")).groupBy(*names).agg(AGGREGATES[agg](F.col("_y")).alias("y"))


def raw_points(df: DataFrame, x: str | Column, y: str, series: str | None = None, facets: list[str] = (), rows: int = 20_000) -> DataFrame:
    """x, y, [series], [facets]: rows as they are, the first so many by x and y."""
    x = F.col(x) if isinstance(x, str) else x
    points = df.select(x.alias("x"), F.col(y).alias("y"), *([F.col(series).alias("series")] if series else []), *[F.col(c).alias(f"facet{i}") for i, c in enumerate(facets, 1)])
    return points.orderBy(*points.columns).limit(rows)


def capped_series(marks: DataFrame, most: int = 8) -> tuple[DataFrame, list[str]]:
    """(marks of the first series by name, notes): what a chart can tell apart."""
    names = [r[0] for r in marks.select(F.coalesce(F.col("series").cast("string"), F.lit("(null)")).alias("s")).distinct().orderBy("s").limit(most + 1).collect()]
    if len(names) <= most:
        return marks, []
    return marks.where(F.coalesce(F.col("series").cast("string"), F.lit("(null)")).isin(names[:most])), [f"the first {most} series are shown"]


def capped_bars(marks: DataFrame, most: int = 60, each: int = 20) -> tuple[DataFrame, list[str]]:
    """(bars of the first categories by x, at most so many for a category and series; notes)."""
    from pyspark.sql.window import Window

    kept = marks.where("y is not null")
    first = [r[0] for r in kept.select("x").distinct().orderBy("x").limit(most + 1).collect()]
    notes = [f"the first {most} categories are shown"] if len(first) > most else []
    if notes:
        kept = kept.where(F.col("x") < F.lit(first[most]))
    by = [c for c in kept.columns if c != "y"]
    numbered = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("y")))
    return numbered.where(F.col("_n") <= each).drop("_n"), notes


def table(df: DataFrame, order: list[str], rows: int = 500) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def scatter(df: DataFrame, x: str, y: str, series: str | None = None, order: list[str] = (), rows: int = 20_000) -> DataFrame:
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return points.orderBy(*(order or [x, y])).select(F.col(x).alias("x"), F.col(y).alias("y"), *([F.col(series).alias("series")] if series else [])).limit(rows)


def histogram(df: DataFrame, x: str, bins: int = 20, by: list[str] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """by, bin, lo, hi, n: bins are shared by all series and facets; empty bins are not listed."""
    from ..types import finite

    bins = min(200, max(2, bins))
    v = df.select(*by, finite(x).alias("v")).where("v is not null")
    if low is not None and high is not None and high > low:
        v = v.where(F.col("v").between(low, high)).withColumn("lo", F.lit(float(low))).withColumn("hi", F.lit(float(high)))
    else:
        span = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        v = v.crossJoin(F.broadcast(span))  # one row
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    b = F.least(F.floor((F.col("v") - F.col("lo")) / width * bins), F.lit(bins - 1)).cast("int")
    counted = v.select(*by, b.alias("bin"), "lo", width.alias("w")).groupBy(*by, "bin", "lo", "w").agg(F.count("*").alias("n"))
    return counted.select(*by, "bin", (F.col("lo") + F.col("bin") * F.col("w") / bins).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * F.col("w") / bins).alias("hi"), "n")


def full_bins(counts: DataFrame, bins: int) -> DataFrame:
    """bin, n with zero for empty bins."""
    every = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts.groupBy("bin").agg(F.sum("n").alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def die_map(df: DataFrame, x: str, y: str, value: str | None = None, agg: str = "avg", facets: list[str] = ()) -> DataFrame:
    """x, y, [facets], v: one cell of a wafer grid."""
    agg = "avg" if agg == "none" else agg
    names = ["x", "y", *[f"facet{i}" for i in range(1, len(facets) + 1)]]
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"), *[F.col(c).alias(f"facet{i}") for i, c in enumerate(facets, 1)], (F.col(value) if value else F.lit(1)).alias("_v"))
    return cells.groupBy(*names).agg(AGGREGATES[agg](F.col("_v")).alias("v"))


def _tick_step(span: float, about: int) -> float:
    """The least of 1, 2, 2.5, 5 and 10 times a power of ten that needs no more than ``about`` steps."""
    raw = span / max(1, about)
    unit = 10.0 ** math.floor(math.log10(raw))
    return next((s * unit for s in (1, 2, 2.5, 5) if s * unit >= raw), 10 * unit)


def _marks(step: float, first: int, last: int) -> list[float]:
    return [round(k * step, 9) for k in range(first, last + 1)]


def nice_ticks(low: float, high: float, about: int = 5) -> list[float]:
    """Round axis marks whose ends enclose the range, one value alike; 0 and 1 if it is not finite."""
    if not (math.isfinite(low) and math.isfinite(high)):
        return [0.0, 1.0]
    low, high = min(low, high), max(low, high)
    if low == high:
        low, high = low - 1, high + 1
    step = _tick_step(high - low, about)
    first = math.floor(low / step + 1e-9)
    return _marks(step, first, max(first + 1, math.ceil(high / step - 1e-9)))


def ticks_within(low: float, high: float, about: int = 5) -> list[float]:
    """Round axis marks within a range that was chosen; its ends where fewer than two fit."""
    if not (math.isfinite(low) and math.isfinite(high) and high > low):
        return [low, high]
    step = _tick_step(high - low, about)
    marks = _marks(step, math.ceil(low / step - 1e-9), math.floor(high / step + 1e-9))
    return marks if len(marks) >= 2 else [low, high]


#: Panels at most: of one facet, of one facet of die maps, of each of two.
FACETS, DIE_FACETS, FACETS_EACH = 12, 25, 6


def capped_facets(marks: DataFrame, die_maps: bool = False) -> tuple[DataFrame, list[str]]:
    """(marks of the first panels by name, notes): what a grid can show; null is a panel named (null)."""
    facets = [c for c in ("facet1", "facet2") if c in marks.columns]
    most = FACETS_EACH if len(facets) == 2 else DIE_FACETS if die_maps else FACETS
    notes = []
    for c in facets:
        name = F.coalesce(F.col(c).cast("string"), F.lit("(null)"))
        values = [r[0] for r in marks.select(F.col(c).alias("v"), name.alias("s")).distinct().orderBy("v", "s").limit(most + 1).select("s").collect()]
        if len(values) > most:
            marks = marks.where(name.isin(values[:most]))
            notes.append(f"the first {most} values of {c} are shown")
    return marks, notes


_CHARTS: dict[str, Callable[..., DataFrame]] = {}


def register_chart(kind: str, build: Callable[..., DataFrame]) -> None:
    _CHARTS[kind] = build


def chart(df: DataFrame, spec: dict) -> DataFrame:
    """Data of a chart: spec has type, the build function's arguments and optional filters."""
    spec = dict(spec)
    kind, filters = spec.pop("type"), spec.pop("filters", {})
    if kind not in _CHARTS:
        raise ValueError(f"unknown chart type {kind}")
    return _CHARTS[kind](dashboard_filter(df, filters), **spec)


def control_chart(df: DataFrame, x: str, value: str, agg: str = "avg") -> DataFrame:
    from . import series as S

    return S.spc(S.series(df, x, value, [], agg))


for _kind, _build in (("table", table), ("scatter", scatter), ("line", aggregate), ("bar", aggregate), ("histogram", histogram), ("wafer", die_map), ("spc", control_chart)):
    register_chart(_kind, _build)


def guess_yield_columns(fields: list[tuple[str, str] | str]) -> dict[str, str | None]:
    """Columns of a yield chart by parts of their names; fields: (name, type name), or names alone.  Without a match x is the first column and y the first numeric one."""
    fields = [(f, "real") if isinstance(f, str) else f for f in fields]
    numeric = [n for n, kind in fields if kind in ("integer", "real")]

    def first(names: list[str], *parts: str) -> str | None:
        return next((n for n in names if any(p in n.lower() for p in parts)), None)

    every = [n for n, _ in fields]
    # fixed values: parts of column names, English and Japanese
    return {
        "x": first(every, "date", "time", "day", "lot", "日付", "日時") or (every[0] if every else None),
        "y": first(numeric, "yield", "歩留") or (numeric[0] if numeric else None),
        "series": first(every, "tool", "装置", "equip"),
    }


def yield_charts(dataset: str, x: str, y: str, series: str | None = None) -> list[dict]:
    """The two charts of the yield preset: the mean by x (and series), and its control chart."""
    if not x or not y or x == y:
        raise ValueError("an order column and another, measured one are needed")
    line = {"type": "line", "x": x, "y": y, "agg": "avg"} | ({"series": series} if series else {})
    return [{"name": f"{y} by {x} ({dataset})", "source": dataset, "spec": line}, {"name": f"control chart of {y} ({dataset})", "source": dataset, "spec": {"type": "spc", "x": x, "value": y, "agg": "avg"}}]
