"""SQLite files, opened read-only, by tasks that each read a range of row numbers.

The driver looks at the names of tables and the range of row numbers only.  Spark hands the file to
the executors; what they read is written once, and the columns' types come from one aggregation of
the kinds of its cells (rows.py).
"""

from __future__ import annotations

import sqlite3
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from ..infer import unique_names
from ..storage import handed_out
from .base import Connector, ImportOptions, SourceError
from .rows import read_by_tasks, typed_frame

#: Row numbers of a task, and tasks at most.
TASK_ROWS, MOST_TASKS = 100_000, 10_000

def _open(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return con


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _ranges(con: sqlite3.Connection, table: str, columns: list[str], most: int | None) -> list[str]:
    """Queries that together give all rows: by ranges of row numbers, or one for a view, a table without them or the first rows only."""
    if most is not None:
        return [f"select * from {_quoted(table)} limit {int(most)}"]
    number = next((n for n in ("rowid", "_rowid_", "oid") if n not in [c.lower() for c in columns]), None)
    ordinary = con.execute("select count(*) from sqlite_master where type = 'table' and name = ?", [table]).fetchone()[0]
    try:
        low, high = con.execute(f"select min({number}), max({number}) from {_quoted(table)}").fetchone() if number and ordinary else (None, None)
    except sqlite3.OperationalError:  # without row numbers
        low = None
    if low is None:
        return [f"select * from {_quoted(table)}"]
    step = max(TASK_ROWS, -(-(high - low + 1) // MOST_TASKS))
    return [f"select * from {_quoted(table)} where {number} between {a} and {min(high, a + step - 1)}" for a in range(low, high + 1, step)]


def _reader(file: str, queries: list[str]):
    def read(piece: int):
        from pyspark import SparkFiles

        con = _open(SparkFiles.get(file))
        try:
            yield from con.execute(queries[piece])
        finally:
            con.close()

    return read


class SqliteConnector(Connector):
    name = "sqlite"
    extensions = ("db", "sqlite", "sqlite3", "db3")

    def objects(self, spark: SparkSession, path: str) -> list[str]:
        with _open(path) as con:
            return [n for (n,) in con.execute("select name from sqlite_master where type in ('table', 'view') and name not like 'sqlite_%' order by name")]

    def load(self, spark: SparkSession, path: str, object: str | None = None, options: ImportOptions = ImportOptions()) -> DataFrame:
        found = self.objects(spark, path)
        chosen = object or next(iter(found), None)
        if chosen not in found:
            raise SourceError(f"no table {chosen}")
        with _open(path) as con:
            columns = [d[0] for d in con.execute(f"select * from {_quoted(chosen)} limit 0").description]
            queries = _ranges(con, chosen, columns, options.max_rows)
        raw, _ = read_by_tasks(spark, len(queries), _reader(handed_out(spark, path), queries), "sqlite")
        return typed_frame(raw, unique_names(columns))
