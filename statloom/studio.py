"""A session of named datasets: import, query, chart, analyse, save."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dialect
from .infer import RAW, dataset_name
from .operators import charts, cluster, groups, hypothesis, profile, series
from .session import run_sql
from .sources import cache
from .sources.base import ImportOptions, Registry, default_registry
from .types import type_name

HISTORY = 20
DEFAULT_LIMIT, MOST_LIMIT = 5_000, 100_000
SUFFIX = ".statloom"


@dataclass
class Dataset:
    name: str
    path: str
    object: str | None = None
    options: dict = field(default_factory=dict)
    columns: list[dict] = field(default_factory=list)
    #: Cells that did not fit their column's type, by column; their text is in ``<column>_raw``.
    outliers: dict[str, int] = field(default_factory=dict)


@dataclass
class QueryResult:
    columns: list[str]
    rows: list[tuple]
    truncated: bool


class Studio:
    def __init__(self, spark: SparkSession, registry: Registry | None = None, use_cache: bool = True):
        self.spark, self.registry, self.use_cache = spark, registry or default_registry(), use_cache
        spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        dialect.create(spark)
        self.name, self.datasets, self.charts, self.queries = "untitled", {}, [], []

    # datasets
    def objects(self, path: str) -> list[str]:
        return self.registry.for_path(path).objects(self.spark, path)

    def preview(self, path: str, object: str | None = None, options: ImportOptions = ImportOptions()) -> DataFrame:
        most = min(options.max_rows or 50, 500)
        return self.registry.for_path(path).load(self.spark, path, object, ImportOptions(options.header_row, options.skip_rows, options.delimiter, most))

    def register(self, name: str, df: DataFrame, path: str = "(derived)", object: str | None = None, options: ImportOptions = ImportOptions()) -> Dataset:
        """A view under a safe name; one of the same name is replaced."""
        name = dataset_name(name)
        if not df.columns:
            raise ValueError("a dataset needs columns")
        df.createOrReplaceTempView(f"`{name}`")
        self.datasets[name] = Dataset(name, path, object, options.as_dict(), [{"name": f.name, "type": type_name(f.dataType)} for f in df.schema.fields])
        return self.datasets[name]

    def load(self, path: str, name: str | None = None, object: str | None = None, options: ImportOptions = ImportOptions()) -> Dataset:
        df = cache.read(self.spark, path, object, options) if self.use_cache else None
        if df is None:
            df = self.registry.for_path(path).load(self.spark, path, object, options)
            if self.use_cache and cache.write(df, path, object, options):
                df = cache.read(self.spark, path, object, options) or df
        found = self.register(name or object or Path(path).stem, df, path, object, options)
        found.outliers = kept_outliers(df)
        return found

    def delete(self, name: str) -> bool:
        self.spark.catalog.dropTempView(name)
        return self.datasets.pop(name, None) is not None

    # queries
    def frame(self, source: str) -> DataFrame:
        """A dataset's name, or SQL text."""
        text = source.strip().rstrip(";").strip()
        return self.spark.table(f"`{text}`") if text in self.datasets else run_sql(self.spark, text)

    def query(self, sql: str, limit: int = DEFAULT_LIMIT, record: bool = True) -> QueryResult:
        df = self.frame(sql)
        limit = max(1, min(limit, MOST_LIMIT))
        rows = [tuple(r) for r in df.limit(limit + 1).collect()] if df.columns else []
        if record:
            self.queries = [sql, *[q for q in self.queries if q != sql]][:HISTORY]
        return QueryResult(df.columns, rows[:limit], len(rows) > limit)

    # charts and analyses
    def chart(self, source: str, spec: dict) -> DataFrame:
        return charts.chart(self.frame(source), spec)

    def filter_values(self, column: str) -> DataFrame:
        return charts.filter_values([self.frame(n) for n in self.datasets], column)

    def profile(self, source: str) -> DataFrame:
        return profile.profile(self.frame(source))

    def set_charts(self, charts_: list[dict]) -> None:
        self.charts = list(charts_)

    def get_charts(self) -> list[dict]:
        return self.charts

    def yield_preset(self, dataset: str, x: str | None = None, y: str | None = None, series_: str | None = None) -> list[dict]:
        """Adds a chart of the mean and a control chart; columns not given are guessed by their names."""
        fields = [(c["name"], c["type"]) for c in self.datasets[dataset].columns]
        guess = charts.guess_yield_columns(fields)
        made = charts.yield_charts(dataset, x or guess["x"], y or guess["y"], series_ or guess["series"])
        self.charts = [*self.charts, *made]
        return made

    def regression(self, source: str, features: list[str], target: str) -> profile.Ols:
        return profile.ols(self.frame(source), features, target)

    def regression_points(self, source: str, features: list[str], target: str, fit: profile.Ols | None = None, most: int = 2000) -> DataFrame:
        """A sample of the regression's rows with the fitted value."""
        df = self.frame(source)
        fit = fit or profile.ols(df, features, target)
        value = F.lit(fit.coef[0])
        for name, c in zip(features, fit.coef[1:]):
            value = value + F.lit(c) * F.col(name)
        return profile.sample_points(df, [*features, target], most).withColumn("fitted", value)

    def cluster(self, source: str, features: list[str], k: int = 3, seed: int = 42, save_as: str | None = None) -> cluster.KMeans:
        df = self.frame(source)
        model = cluster.kmeans(df, features, k, seed)
        if save_as:
            self.register(save_as, cluster.assign(df, features, model))
        return model

    def cluster_points(self, source: str, features: list[str], model: cluster.KMeans, most: int = 5000) -> DataFrame:
        """A sample of the rows with their cluster."""
        return cluster.assign(profile.sample_points(self.frame(source), features, most), features, model)

    def elbow(self, source: str, features: list[str], k_max: int = 10):
        return cluster.elbow(self.frame(source), features, k_max)

    def timeseries(self, source: str, x: str, y: str, period: int = 7, how: str = "sum", multiplicative: bool = False) -> DataFrame:
        return series.decompose(series.series(self.frame(source), x, y, [], how), min(366, max(2, period)), [], multiplicative)

    def spc(self, source: str, x: str, y: str, how: str = "avg") -> DataFrame:
        return series.spc(series.series(self.frame(source), x, y, [], how))

    def tool_difference(self, source: str, group: str, value: str) -> dict:
        return hypothesis.tool_difference(self.frame(source), group, value)

    def lot_trace(self, column: str, value: str, partial: bool = False) -> tuple[DataFrame, int]:
        return groups.lot_trace({n: self.frame(n) for n in self.datasets}, column, value, partial)

    def for_each(self, source: str, by: list[str], kind: str, **kw) -> tuple[DataFrame, int]:
        return groups.for_each(self.frame(source), by, kind, **kw)

    def advise(self, source: str, mode: str, **columns) -> dict:
        return hypothesis.advise(self.frame(source), mode, **columns)

    def test(self, source: str, test: str, **kw) -> hypothesis.TestResult:
        return hypothesis.run_test(self.frame(source), test, **kw)

    # projects
    def save(self, path: str) -> str:
        path = path if path.endswith((SUFFIX, ".json")) else path + SUFFIX
        data = {"version": 1, "name": self.name, "datasets": [asdict(d) for d in self.datasets.values()], "charts": self.charts, "queries": self.queries}
        Path(path).write_text(json.dumps(data, ensure_ascii=False, indent=2), encoding="utf-8")
        return path

    def open(self, path: str) -> list[str]:
        """Errors of datasets that could not be loaded again; derived ones are skipped."""
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        for n in list(self.datasets):
            self.delete(n)
        self.name, self.charts, self.queries = data["name"], data.get("charts", []), data.get("queries", [])
        errors = []
        for d in data["datasets"]:
            if d["path"].startswith("("):
                continue
            try:
                self.load(d["path"], d["name"], d.get("object"), ImportOptions(**d.get("options", {})))
            except Exception as e:
                errors.append(f"{d['name']}: {e}")
        return errors

    def state(self) -> dict:
        return {"name": self.name, "datasets": [asdict(d) for d in self.datasets.values()], "charts": self.charts, "queries": self.queries}


def kept_outliers(df: DataFrame) -> dict[str, int]:
    """Cells in the ``_raw`` columns that an import adds for what does not fit."""
    raw = [c for c in df.columns if c.endswith(RAW) and c.removesuffix(RAW) in df.columns]
    if not raw:
        return {}
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(raw)]).first()
    return {c.removesuffix(RAW): n for c, n in zip(raw, row) if n}


def row_count(df: DataFrame) -> int:
    return df.agg(F.count("*")).first()[0]
