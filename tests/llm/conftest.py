import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


LONG = " ".join(f"word{i * 7919 % 4001}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(70))
BASE = " ".join(f"base{i}" for i in range(120))

#: Nulls, empty and blank texts, repeated rows, ties, a very long text, copies, shared passages, odd blanks.
CASES = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, BASE + " tail", "en", None),
    (4, "x " + PASSAGE + " y", "de", "b"),
    (5, "other start " + PASSAGE + "\nz z", "de", "b"),
    (6, None, None, None),
    (7, "", "en", "c"),
    (8, " \t\n \x0b", "en", "c"),
    (9, "one", "fr", "c"),
    (10, "One", "fr", "c"),
    (11, "one two", "fr", "c"),
    (12, LONG, "en", "d"),
    (13, "dup dup dup dup " * 30, "en", "d"),
    (14, "Line one is here and long enough\nLine one is here and long enough\n\n# * $ % & | < >", "en", "d"),
    (15, "Released under the MIT License. Apache License, and the GNU General Public License version 3", "en", "e"),
    (15, "Released under the MIT License. Apache License, and the GNU General Public License version 3", "en", "e"),
    (None, BASE, "en", "a"),
    (None, None, None, None),
    (16, "héllo wörld <|endoftext|> don't 你好 \U0001f600 12345 ẞİ", "xx", "e"),
    (17, "\n".join(f"this is quite a long line number {i} with several words in it" for i in range(12)), "en", "e"),
]


@pytest.fixture(scope="session")
def cases(spark):
    """Documents with extra, clashing columns."""
    rows = [(i, t, l, s, len(t or ""), 1, "v", 2) for i, t, l, s in CASES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k int, pos string, size int").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(cases):
    return cases.where("false")
