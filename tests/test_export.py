"""CSV files that tasks have written, read by Python."""

import csv

from statloom.sources.export import to_csv


def test_one_file_in_order(spark, tmp_path):
    rows = [(i, [None, "", " lead", 'say "hi"', "a,b", "two\nlines", "é太郎", "trail "][i % 8], i / 4, i % 3 == 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "i int, `odd, name` string, r double, b boolean").repartitionByRange(7, "i").sortWithinPartitions("i")
    path = str(tmp_path / "o.csv")
    assert to_csv(df, path) == 1000
    with open(path, encoding="utf-8-sig", newline="") as f:
        got = list(csv.reader(f))
    assert got[0] == ["i", "odd, name", "r", "b"]
    assert got[1:] == [[str(i), t or "", str(r), str(b).lower()] for i, t, r, b in rows]
    assert to_csv(df.where("false").toDF("a", "a", "b", "c"), path, bom=False) == 0
    assert open(path, encoding="utf-8").read() == "a,a,b,c\n"
