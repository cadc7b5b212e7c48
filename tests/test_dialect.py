"""SQL functions of the query box against Python's own SQLite."""

import random
import sqlite3

import pytest

from statloom.functions import dialect
from statloom.studio import Studio


@pytest.fixture(scope="module")
def both(spark):
    dialect.create(spark)
    con = sqlite3.connect(":memory:")

    def ask(calls):
        ours = spark.sql("SELECT " + ", ".join(f"{c} AS c{i}" for i, c in enumerate(calls))).first()
        theirs = con.execute("SELECT " + ", ".join(calls)).fetchone()
        return list(zip(calls, ours, theirs))

    return ask


def test_moments_and_modifiers(both):
    rng = random.Random(3)
    calls = []
    for _ in range(25):
        t = f"'{rng.randint(1950, 2090)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" + rng.choice(["'", f" {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}'", f" {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}.250'"])
        m = rng.choice(["", ", 'start of month'", ", 'start of year', '+3 days'", f", '{rng.randint(-40, 40):+d} months'", f", '{rng.randint(-9, 9):+d} years'", f", '{rng.randint(-500, 500)} hours'", ", '-1.5 days'", f", '+{rng.randint(1, 900)} minutes', 'start of day'", ", '+30 seconds'"])
        calls += [f"datetime({t}{m})", f"strftime('%Y|%m|%d|%H|%M|%S|%j|%w|%s|%%|%f', {t}{m})", f"julianday({t}{m})"]
    calls += ["datetime('2024-01-31', '+1 month')", "datetime('2023-01-31', '+1 month')", "datetime('2024-02-29', '+1 year')", "strftime('%Y-%m-%d', 2451545.0)", "datetime(2451545.25)", "julianday('2000-01-01 12:00')", "strftime('%Y', 'nonsense')", "strftime('%d', NULL)", "datetime('12:34:56')", "strftime('no letters', '2000-01-01')"]
    for call, ours, theirs in both(calls):
        assert ours == (pytest.approx(theirs, abs=1e-8) if isinstance(theirs, float) else theirs), call


def test_glob(spark):
    dialect.create(spark)
    patterns = ["*", "?", "a*", "*c", "a?c", "[ab]*", "[^a]*", "a.c", "a+", "(x)", "[a-c][0-9]", "*[?]*", "[*]", "x|y", "", "a\\d", "{2}", "é*"]
    texts = ["", "a", "abc", "a.c", "aac", "b1", "x|y", "(x)", "a+", "what?", "*", "A", "line\nbreak", "a\\d", "{2}", "étage"]
    con = sqlite3.connect(":memory:")
    frame = spark.createDataFrame([(p, t) for p in patterns for t in texts], "p string, t string")
    for r in frame.selectExpr("p", "t", "glob(p, t) AS found").collect():
        assert r["found"] == bool(con.execute("SELECT ? GLOB ?", (r["t"], r["p"])).fetchone()[0]), r


def test_query_box(spark):
    studio = Studio(spark, use_cache=False)
    studio.register("lots", spark.createDataFrame([("L1", "2024-03-05"), ("L2", "2024-04-01"), ("X3", None)], "lot string, made string"))
    assert studio.query("SELECT lot, strftime('%Y-%m', made) AS month FROM lots WHERE glob('L*', lot) ORDER BY lot").rows == [("L1", "2024-03"), ("L2", "2024-04")]
    assert studio.query("SELECT max(julianday(made)) - min(julianday(made)) AS days FROM lots").rows == [(27.0,)]
