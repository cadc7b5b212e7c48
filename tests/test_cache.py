"""The import cache: whole tables or none, with several writers, changed files and broken entries."""

import threading

import pytest

from statloom.sources import cache
from statloom.sources.base import ImportOptions, default_registry
from statloom.studio import Studio

NONE = ImportOptions()


@pytest.fixture
def source(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("STATLOOM_CACHE_DIR", f"file://{tmp_path}/cache")
    path = tmp_path / "a.csv"
    path.write_text("a,b\n" + "".join(f"{i},x{i}\n" for i in range(500)))
    return path


def loaded(spark, path):
    return default_registry().for_path(str(path)).load(spark, str(path), None, NONE)


def test_writers_that_race(spark, source):
    """Eight writers and a reader at once: the reader sees nothing or everything."""
    df, done, seen = loaded(spark, source), [], []
    stop = threading.Event()

    def look():
        while not stop.is_set():
            found = cache.read(spark, str(source), None, NONE)
            seen.append(None if found is None else found.count())

    reader = threading.Thread(target=look)
    writers = [threading.Thread(target=lambda: done.append(cache.write(df, str(source), None, NONE))) for _ in range(8)]
    for t in [reader, *writers]:
        t.start()
    for t in writers:
        t.join()
    stop.set()
    reader.join()
    assert done == [True] * 8 and set(seen) <= {None, 500}
    assert sorted(tuple(r) for r in cache.read(spark, str(source), None, NONE).collect()) == sorted((i, f"x{i}") for i in range(500))


def test_misses(spark, source, tmp_path):
    assert cache.read(spark, str(source), None, NONE) is None
    assert cache.write(loaded(spark, source), str(source), None, NONE)
    assert cache.read(spark, str(source), "other", NONE) is None and cache.read(spark, str(source), None, ImportOptions(skip_rows=1)) is None
    source.write_text("a,b\n1,y\n")
    assert cache.read(spark, str(source), None, NONE) is None
    assert cache.write(loaded(spark, source), str(source), None, NONE)
    assert [tuple(r) for r in cache.read(spark, str(source), None, NONE).collect()] == [(1, "y")]
    entry = next((tmp_path / "cache").iterdir())
    assert len([p for p in entry.iterdir() if not p.name.startswith(".")]) == 2  # the older table went
    marker = next(p for p in entry.iterdir() if p.suffix == ".json")
    for crc in entry.glob(".*.crc"):
        crc.unlink()
    marker.write_text("{broken")
    assert cache.read(spark, str(source), None, NONE) is None
    assert cache.write(loaded(spark, source), str(source), None, NONE) and cache.read(spark, str(source), None, NONE).count() == 1
    assert not cache.write(loaded(spark, source), "mysql://h/d", None, NONE)


def test_a_failing_cache_does_not_fail_the_import(spark, source, tmp_path, monkeypatch):
    blocked = tmp_path / "file"
    blocked.write_text("no folder")
    monkeypatch.setenv("STATLOOM_CACHE_DIR", str(blocked))
    studio = Studio(spark)
    studio.load(str(source))
    assert studio.query("select count(*) as n from a").rows == [(500,)]


def test_cells_beside_their_type_come_back(spark, source):
    source.write_text("n,t\n" + "1,x\n" * 2400 + "N/A,x\n")
    studio = Studio(spark)
    assert studio.load(str(source)).outliers == {"n": 1}
    again = Studio(spark)
    assert cache.read(spark, str(source), None, NONE) is not None and again.load(str(source)).outliers == {"n": 1}
    assert again.query("select n_raw from a where n is null").rows == [("N/A",)]


def test_the_folder_is_shared_on_a_cluster(spark, monkeypatch):
    for var in ("STATLOOM_CACHE_DIR", "LOCALAPPDATA", "XDG_CACHE_HOME"):
        monkeypatch.delenv(var, raising=False)
    monkeypatch.setenv("HOME", "/home/someone")
    assert cache.cache_dir(spark) == "/home/someone/.cache/statloom"

    class Remote:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            values = {"spark.checkpoint.dir": "hdfs://host/shared/"}

            @classmethod
            def get(cls, name, default=None):
                return cls.values.get(name, default)

    assert cache.cache_dir(Remote) == "hdfs://host/shared/statloom-cache"
    Remote.conf.values = {}
    with pytest.raises(ValueError, match="share"):
        cache.cache_dir(Remote)
