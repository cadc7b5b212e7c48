"""Quoted text that is cut into many splits, against Python's own reader."""

import csv
import io
import random

import pytest

from statloom.sources import quoted
from statloom.sources.base import ImportOptions, SourceError, default_registry


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "150")
    spark.conf.set(names[1], "1")
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def test_how_lines_end():
    cases = [
        ('a,b', False, False), ('"a,b', False, True), ('a",b', False, False), ('a"b,"c', False, True), ('"a""b"', False, False), ('"a""', False, True),
        ('x","y"', True, False), ('x', True, True), ('""', True, True), ('x"",y', True, True), ('x",y', True, False), ('"', True, False), ('', True, True), ('', False, False), ('"a"b,"c"', False, False),
    ]
    for line, inside, want in cases:
        assert quoted.ends_inside(line, inside, ",") == want, line


def random_rows(rng, n):
    cell = lambda: rng.choice(["", "x", "plain text", "a,b", 'say "hi"', "two\nlines", "\n\n", '"', ",", "é太郎", "many\n" * 30, "12", "3.5"])
    return [[str(i), *[cell() for _ in range(rng.choice([3, 3, 3, 2, 5]))]] for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_all_splits_agree_with_one_reader(spark, tmp_path, tiny_splits, end):
    rng = random.Random(11)
    rows = random_rows(rng, 300)
    text = io.StringIO()
    csv.writer(text, lineterminator=end).writerows([["id", "p", "q", "r"], *rows])
    path = tmp_path / "q.csv"
    path.write_bytes(b"\xef\xbb\xbf" + text.getvalue().encode())
    found = quoted.records(spark, str(path), "UTF-8", ",")
    got = {r["number"]: (r["record"], r["n_fields"]) for r in found.collect()}
    assert found.rdd.getNumPartitions() > 20 and sorted(got) == list(range(301))
    for i, row in enumerate(rows, 1):
        assert next(csv.reader(io.StringIO(got[i][0], newline=""))) == row and got[i][1] == len(row)
    df = default_registry().for_path(str(path)).load(spark, str(path), None, ImportOptions())
    assert df.columns == ["id", "p", "q", "r", "column_5", "column_6"] and dict(df.dtypes)["id"] == "bigint"
    by_id = {r["id"]: r for r in df.collect()}
    assert sorted(by_id) == list(range(300))
    for row in rows:
        cells = [c if c.strip(" ") else None for c in row[1:]]
        assert list(by_id[int(row[0])])[1:] == cells + [None] * (5 - len(cells))
    some = default_registry().for_path(str(path)).load(spark, str(path), None, ImportOptions(skip_rows=7, max_rows=50))
    assert sorted(r["id"] for r in some.collect()) == list(range(7, 57))


def test_a_record_over_several_splits(spark, tmp_path, tiny_splits):
    long = "line\n" * 120  # some 600 bytes, four splits
    path = tmp_path / "l.csv"
    path.write_text(f'k,v\n1,"{long}"\n2,after\n', encoding="utf-8")
    df = default_registry().for_path(str(path)).load(spark, str(path), None, ImportOptions())
    assert {r["k"]: r["v"] for r in df.collect()} == {1: long, 2: "after"}


def test_quotes_of_another_encoding(spark, tmp_path, tiny_splits):
    rows = [(i, "表\n示" * (i % 5) + "ソ") for i in range(60)]  # second bytes that are ASCII letters
    text = "".join(f'{i},"{t}"\n' for i, t in rows)
    path = tmp_path / "j.csv"
    path.write_bytes(("番,値\n" + text).encode("shift_jis"))
    df = default_registry().for_path(str(path)).load(spark, str(path), None, ImportOptions())
    assert df.columns == ["番", "値"] and sorted(tuple(r) for r in df.collect()) == rows


def test_a_quote_that_is_not_closed(spark, tmp_path, tiny_splits):
    path = tmp_path / "u.csv"
    path.write_text('k,v\n1,"open\n' + "2,x\n" * 900, encoding="utf-8")
    with pytest.raises(SourceError, match="not closed"):
        default_registry().for_path(str(path)).load(spark, str(path), None, ImportOptions())
    path = tmp_path / "e.csv"
    path.write_text('k,v\n1,"x"\n2,"open\nto the end', encoding="utf-8")
    df = default_registry().for_path(str(path)).load(spark, str(path), None, ImportOptions())
    assert df.count() == 2
