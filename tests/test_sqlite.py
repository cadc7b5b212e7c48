"""SQLite files read by many tasks."""

import random
import sqlite3

import pytest

from statloom.sources import sqlite
from statloom.sources.base import ImportOptions, SourceError
from statloom.studio import Studio


@pytest.fixture
def file(tmp_path):
    rng = random.Random(1)
    path = str(tmp_path / "d.db")
    con = sqlite3.connect(path)
    con.execute("create table big (n integer, r, mixed, t text, empty, b blob)")
    rows = []
    for i in range(1000):
        mixed = rng.choice([i, i / 4, f"t{i}", None, float(i), "7"]) if i > 600 else i
        rows.append((i * 3, rng.choice([i, i + 0.5]), mixed, f"x\n{i}", None, b"\x00\xff"))
    con.executemany("insert into big values (?, ?, ?, ?, ?, ?)", rows)
    con.execute("delete from big where rowid between 200 and 330")
    con.execute("create table keyed (k text primary key, v) without rowid")
    con.executemany("insert into keyed values (?, ?)", [(f"k{i}", i) for i in range(50)])
    con.execute('create table "odd ""name" (rowid text, "a b", "c,d")')
    con.execute('insert into "odd ""name" values (?, ?, ?)', ("r", 1, float("inf")))
    con.execute("create view seen as select n, t from big where n < 30")
    con.execute("create table none (a, b)")
    con.commit()
    con.close()
    return path, [r for i, r in enumerate(rows, 1) if not 200 <= i <= 330]


def test_tasks_read_ranges(spark, file, monkeypatch):
    path, rows = file
    monkeypatch.setattr(sqlite, "TASK_ROWS", 90)
    c = sqlite.SqliteConnector()
    with sqlite3.connect(path) as con:
        queries = sqlite._ranges(con, "big", ["n"], None)
    assert len(queries) == 12
    df = c.load(spark, path, "big")
    assert dict(df.dtypes) == {"n": "bigint", "r": "double", "mixed": "string", "mixed_cell": "variant", "t": "string", "empty": "string", "b": "string"}
    got = sorted(df.collect(), key=lambda r: r["n"])
    assert [(r["n"], r["r"], r["t"], r["empty"], r["b"]) for r in got] == [(n, float(x), t, None, "[blob]") for n, x, _, t, _, _ in rows]
    cells = [None if r["mixed_cell"] is None else r["mixed_cell"].toPython() for r in got]
    assert [(type(c), c) for c in cells] == [(type(m), m) for _, _, m, *_ in rows]
    text = [None if m is None else m if isinstance(m, str) else str(int(m)) if float(m).is_integer() else str(m) for _, _, m, *_ in rows]
    assert [r["mixed"] for r in got] == text


def test_other_tables(spark, file):
    path, rows = file
    c = sqlite.SqliteConnector()
    assert c.objects(spark, path) == ["big", "keyed", "none", 'odd "name', "seen"]
    assert sorted(tuple(r) for r in c.load(spark, path, "keyed").collect()) == sorted((f"k{i}", i) for i in range(50))
    assert sorted(tuple(r) for r in c.load(spark, path, "seen").collect()) == [(n, t) for n, _, _, t, *_ in rows if n < 30]
    odd = c.load(spark, path, 'odd "name')
    assert odd.columns == ["rowid", "a b", "c,d"] and [tuple(r) for r in odd.collect()] == [("r", 1, float("inf"))]
    none = c.load(spark, path, "none")
    assert none.columns == ["a", "b"] and none.count() == 0
    assert c.load(spark, path, "big", ImportOptions(max_rows=7)).count() == 7
    with pytest.raises(SourceError):
        c.load(spark, path, "absent")


def test_mixed_cells_survive_the_cache(spark, file, tmp_path, monkeypatch):
    path, rows = file
    monkeypatch.setenv("STATLOOM_CACHE_DIR", str(tmp_path / "cache"))
    for _ in range(2):  # the second time from the cache
        studio = Studio(spark)
        studio.load(path, object="big")
        assert studio.query("select sum(try_cast(mixed_cell as bigint)) as n from big where schema_of_variant(mixed_cell) = 'BIGINT'").rows == [(sum(m for _, _, m, *_ in rows if type(m) is int),)]
        assert studio.profile("big").where("column = 'mixed'").first()["kind"] == "text"
    with sqlite3.connect(path) as con:
        con.execute("update big set t = 'changed'")
    studio = Studio(spark)
    studio.load(path, object="big")
    assert studio.query("select distinct t from big").rows == [("changed",)]
