"""Column names and types of untyped tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose cells decide the types of a text table.
SAMPLE_ROWS = 2000

INTEGER = r"^[+-]?[0-9]+$"
REAL = r"(?i)^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|inf|infinity|nan)$"


def unique_names(names: list[str | None]) -> list[str]:
    """Trimmed, never blank, each once (suffixes are tried until one is free)."""
    trimmed = [(n or "").strip() or f"column_{i}" for i, n in enumerate(names, 1)]
    used: set[str] = set()
    out = []
    for name in trimmed:
        new, k = name, 1
        while new in used or (k > 1 and new in trimmed):
            k += 1
            new = f"{name}_{k}"
        used.add(new)
        out.append(new)
    return out


def dataset_name(name: str) -> str:
    """A table name: letters, digits, _ and anything beyond ASCII stay."""
    return "".join(c if c.isascii() and c.isalnum() or c == "_" or ord(c) > 0x7F else "_" for c in name.strip()) or "dataset"


def parse_cell(text: str | None):
    """None, an int, a float or the text of one cell."""
    cell = (text or "").strip()
    if not cell:
        return None
    plain = cell.replace(",", "")
    if re.match(INTEGER, plain) and -(1 << 63) <= int(plain) < 1 << 63:
        return int(plain)
    return float(plain) if re.match(REAL, plain) else text


def cell_types(rows: list[list[str | None]], width: int) -> list[str]:
    """integer, real or text for each column, from sampled rows; blank cells say nothing."""
    out = []
    for i in range(width):
        cells = [parse_cell(r[i]) for r in rows if i < len(r)]
        kinds = {type(c) for c in cells if c is not None}
        out.append("integer" if kinds == {int} else "real" if kinds and kinds <= {int, float} else "text")
    return out


def typed(c: Column, kind: str) -> Column:
    """A text column as its type; blank and ill-typed cells become null."""
    cell = F.when(F.trim(c) != "", F.trim(c))
    if kind == "text":
        return F.when(F.trim(c) != "", c)
    plain = F.replace(cell, F.lit(","))
    if kind == "integer":
        return F.when(plain.rlike(INTEGER), plain.try_cast("bigint"))
    return F.when(plain.rlike(REAL), plain.try_cast("double"))


#: Suffix of a column that holds the text of cells which do not fit their column's type.
RAW = "_raw"


def apply_types(raw: DataFrame, names: list[str], kinds: list[str]) -> DataFrame:
    """Typed columns; one with cells that do not fit gets a neighbour with their text, so that nothing is lost."""
    bad = {r["column"] for r in outliers(raw, names, kinds).collect()}  # a row for each column at most
    out = []
    for c, n, k in zip(raw.columns, names, kinds):
        cell = F.col(f"`{c}`")
        out.append(typed(cell, k).alias(n))
        if n in bad:
            out.append(F.when((F.trim(cell) != "") & typed(cell, k).isNull(), cell).alias(unique_names([*names, n + RAW])[-1]))
    return raw.select(*out)


def outliers(raw: DataFrame, names: list[str], kinds: list[str]) -> DataFrame:
    """column, cells: cells that have text but not their column's type, over all rows; the import report."""
    checked = [(c, n, k) for c, n, k in zip(raw.columns, names, kinds) if k != "text"]
    if not checked:
        return raw.sparkSession.createDataFrame([], "column string, cells long")
    one = raw.agg(*[F.count_if((F.trim(F.col(f"`{c}`")) != "") & typed(F.col(f"`{c}`"), k).isNull()).alias(f"c{i}") for i, (c, _, k) in enumerate(checked)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("cells")) for i, (_, n, _) in enumerate(checked)])).alias("x")).select("x.*").where("cells > 0")
