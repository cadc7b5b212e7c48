from statloom.sources.base import ImportOptions, default_registry

HEAD = "a,b\n" + "1,plain\n" * 140_000  # more than the first MB


def load(spark, path, data):
    path.write_bytes(data)
    return default_registry().for_path(str(path)).load(spark, str(path), None, ImportOptions())


def test_quoted_line_break_after_the_head(spark, tmp_path):
    df = load(spark, tmp_path / "q.csv", (HEAD + '2,"two\nlines"\n3,end\n').encode())
    assert df.count() == 140_002
    assert sorted(tuple(r) for r in df.where("a > 1").collect()) == [(2, "two\nlines"), (3, "end")]


def test_encoding_shows_after_the_head(spark, tmp_path):
    df = load(spark, tmp_path / "s.csv", (HEAD + "2,太郎\n").encode("shift_jis"))
    assert [tuple(r) for r in df.where("a = 2").collect()] == [(2, "太郎")]
    df = load(spark, tmp_path / "u.csv", (HEAD + "2,太郎\n").encode())
    assert [tuple(r) for r in df.where("a = 2").collect()] == [(2, "太郎")]


def test_outliers_after_the_sample_are_kept(spark, tmp_path):
    df = load(spark, tmp_path / "o.csv", ("n,t\n" + "1,x\n" * 2400 + "N/A,x\n" + "2,y\n" * 99).encode())
    assert df.columns == ["n", "n_raw", "t"] and df.where("n is null").count() == 1
    assert [r["n_raw"] for r in df.where("n_raw is not null").collect()] == ["N/A"]


def test_quoted_delimiters_do_not_widen(spark, tmp_path):
    df = load(spark, tmp_path / "w.csv", (HEAD + '2,"one, two, three,\nfour, five"\n').encode())
    assert df.columns == ["a", "b"] and df.count() == 140_001
    df = load(spark, tmp_path / "r.csv", (HEAD + '2,"x",y,z\n').encode())
    assert df.columns == ["a", "b", "column_3", "column_4"]
