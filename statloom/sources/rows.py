"""Typed tables of cells that have types of their own: parsed by tasks, or small ones by the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from ..types import column_type

_NAMES = {bool: "boolean", int: "integer", float: "real", str: "text", type(None): "null"}
_SQL = {"boolean": "boolean", "integer": "bigint", "real": "double", "text": "string"}


def as_text(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(int(v)) if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else str(v)


def frame_of(spark: SparkSession, names: list[str], rows: list[list], hints: list[str | None] | None = None) -> DataFrame:
    """Rows of None, bool, int, float and str; each column has the least type that holds all of it."""
    width = len(names)
    rows = [[*r[:width], *[None] * (width - len(r))] for r in rows]
    kinds = []
    for i in range(width):
        seen = [_NAMES[type(r[i])] for r in rows]
        hint = (hints or [None] * width)[i]
        kinds.append(column_type(seen + ([hint] if hint in _SQL and set(seen) <= {"null"} else [])))

    def convert(v, kind):
        if v is None:
            return None
        return as_text(v) if kind == "text" else float(v) if kind == "real" else int(v) if kind == "integer" else v

    schema = ", ".join(f"`{n.replace('`', '``')}` {_SQL[k]}" for n, k in zip(names, kinds))
    return spark.createDataFrame([tuple(convert(v, k) for v, k in zip(r, kinds)) for r in rows], schema)


#: Kinds of cells by their number.
KINDS = ("null", "integer", "real", "text", "boolean")
#: Suffix of a column that keeps the cells of a mixed column as they were.
CELL = "_cell"
#: Rows that a task gives out at once.
BATCH = 4096


def _kind(v) -> int:
    return 0 if v is None else 4 if isinstance(v, bool) else 1 if isinstance(v, int) else 2 if isinstance(v, float) else 3


def _plain(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return "[blob]" if isinstance(v, bytes) else str(v).lower() if isinstance(v, bool) else repr(v)


def read_by_tasks(spark: SparkSession, pieces: int, read: Callable[[int], Iterable[Iterable]], name: str) -> tuple[DataFrame, int]:
    """(piece, number (within the piece), cells (array of k: kind, s: text)) of what read(piece) gives in a task of its own, written; and how many rows."""

    def run(batches):
        import pyarrow as pa

        cell = pa.struct([("k", pa.int8()), ("s", pa.string())])

        def batch(piece, first, rows):
            cells = [[{"k": _kind(v), "s": _plain(v)} for v in r] for r in rows]
            return pa.RecordBatch.from_arrays([pa.array([piece] * len(rows)), pa.array(range(first, first + len(rows))), pa.array(cells, pa.list_(cell))], ["piece", "number", "cells"])

        for b in batches:
            for piece in b.column("id").to_pylist():
                held, first = [], 0
                for row in read(piece):
                    held.append(row)
                    if len(held) == BATCH:
                        yield batch(piece, first, held)
                        held, first = [], first + BATCH
                if held:
                    yield batch(piece, first, held)

    return written(spark.range(0, pieces, 1, pieces).mapInArrow(run, "piece long, number long, cells array<struct<k: tinyint, s: string>>"), name)


def typed_frame(raw: DataFrame, names: list[str], whole_reals: bool = False) -> DataFrame:
    """The named columns of rows with ``cells``, each with the least type that holds all of it.

    A column that mixes texts and others is text, and has a VARIANT column beside it that keeps each cell
    as it was.  With ``whole_reals`` a column of whole reals only is one of integers.
    """
    cells = raw.select(F.posexplode("cells").alias("at", "c")).select("at", "c.k", F.when(F.col("c.k") == 2, F.col("c.s").try_cast("double")).alias("v"))
    whole = F.bool_and((F.col("v") == F.floor("v")) & (F.abs("v") < 9e15)) if whole_reals else F.lit(False)
    found = {r["at"]: r for r in cells.groupBy("at").agg(F.collect_set("k").alias("kinds"), F.coalesce(whole, F.lit(False)).alias("whole")).collect()}  # a row for each column
    out = []
    for i, name in enumerate(names):
        kinds = {KINDS[k] for k in found[i]["kinds"]} - {"null"} if i in found else set()
        out += _columns(F.get("cells", F.lit(i)), name, kinds, i in found and found[i]["whole"])
    df = raw.select(*out)
    # a name with the suffix may be taken
    from ..infer import unique_names

    return df.toDF(*unique_names(df.columns))


def _columns(cell: Column, name: str, kinds: set[str], whole: bool) -> list[Column]:
    k, s = cell["k"], cell["s"]
    real = s.try_cast("double")
    kind = "integer" if kinds == {"real"} and whole else column_type(kinds)
    if kind == "boolean":
        return [(s == "true").alias(name)]
    flag = F.when(k == 4, F.when(s == "true", 1).otherwise(0))
    if kind == "integer":
        return [(F.coalesce(flag, s.try_cast("bigint")) if kinds != {"real"} else real.cast("bigint")).alias(name)]
    if kind == "real":
        return [F.coalesce(flag.cast("double"), real).alias(name)]
    text = F.when((k == 2) & (real == F.floor(real)) & (F.abs(real) < 1e15), real.cast("bigint").cast("string")).otherwise(s).alias(name)
    if kinds <= {"text"}:
        return [text]
    own = F.when(k == 1, s.try_cast("bigint").cast("variant")).when(k == 2, real.cast("variant")).when(k == 3, s.cast("variant")).when(k == 4, (s == "true").cast("variant"))
    return [text, own.alias(name + CELL)]
