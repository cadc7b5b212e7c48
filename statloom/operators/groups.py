"""Analyses for each value of one or two columns in one job, and lot tracing over datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster as C
from . import profile as P
from . import series as S

MOST_ONE, MOST_TWO = 12, 36


def chosen_groups(df: DataFrame, groups: list[str]) -> tuple[list[tuple], int]:
    """The first values (or pairs) in order, as many as are shown, and how many there are."""
    if not 1 <= len(groups) <= 2:
        raise ValueError("one or two group columns")
    most = MOST_ONE if len(groups) == 1 else MOST_TWO
    values = df.select(*groups).dropna().distinct()
    total = values.count()
    return [tuple(r) for r in values.orderBy(*groups).limit(most).collect()], total


def for_each(df: DataFrame, groups: list[str], kind: str, **kw) -> tuple[DataFrame, int]:
    """(rows with group columns and an error column, total groups); a group's error does not stop the others."""
    shown, total = chosen_groups(df, groups)
    keep = F.lit(False)
    for values in shown:
        match = F.lit(True)
        for g, v in zip(groups, values):
            match = match & (F.col(g) == F.lit(v))
        keep = keep | match
    part = df.where(keep)
    if kind == "spc":
        return S.spc(S.series(part, kw["x"], kw["y"], groups, kw.get("how", "avg")), groups), total
    if kind == "timeseries":
        points = S.series(part, kw["x"], kw["y"], groups, kw.get("how", "sum"))
        return S.decompose(points, min(366, max(2, kw.get("period", 7))), groups, kw.get("multiplicative", False)), total
    if kind == "regression":
        return P.ols_groups(part, kw["x"], kw["y"], groups), total
    if kind == "profile":
        columns = [c for c in kw["columns"] if c not in groups]
        return P.profile(part.select(*groups, *columns), groups).withColumn("error", F.lit(None).cast("string")), total
    if kind == "cluster":
        return C.kmeans_groups(part, groups, shown, kw["features"], kw.get("k", 3), kw.get("seed", 42)), total
    raise ValueError(f"{kind} cannot run for each group")


def lot_trace(frames: dict[str, DataFrame], column: str, value: str, partial: bool = False, most: int = 500) -> tuple[DataFrame, int]:
    """(dataset, row as JSON; searched datasets): rows of every dataset that has the column, whatever its case."""
    if not str(value).strip():
        raise ValueError("a value is needed")
    found, searched = None, 0
    for name, df in sorted(frames.items()):
        own = next((c for c in df.columns if c.lower() == column.lower()), None)
        if own is None:
            continue
        searched += 1
        text = F.col(f"`{own}`").cast("string")
        if partial:
            escaped = str(value).replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
            hit = text.ilike(f"%{escaped}%")
        else:
            hit = text == F.lit(str(value))
        rows = df.where(hit).select(F.lit(name).alias("dataset"), F.to_json(F.struct("*")).alias("row"))
        rows = rows.orderBy("row").limit(most) if most else rows  # the same rows in each run
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError(f"no dataset has a column {column}")
    return found, searched
