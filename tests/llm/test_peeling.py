"""The n-gram join peels off sets that link with nothing before it looks for candidates."""

import numpy as np
import pytest

from statloom.llm import common
from statloom.llm import ngram_join as N


def mosaics(rng, many=300):
    """Documents that share passages of 20 words two by two, in a chain; some pairs of near copies; odd ones."""
    passages = [[f"p{i}w{j}" for j in range(20)] for i in range(many + 1)]
    rows = [(i, " ".join([*passages[i], *(f"own{i}x{j}" for j in range(int(rng.integers(20, 60)))), *passages[i + 1]])) for i in range(many)]
    for i in range(0, many, 10):
        rows.append((many + i, rows[i][1] + " tail"))
    return rows + [(5000, "one two"), (5001, "one two"), (5002, "alone"), (5002, rows[3][1]), (None, rows[4][1]), (5003, None), (5004, "")]


def sets_of(frame, n=5):
    described = frame.mapInArrow(N._describe(n, 0), N.DESCRIBED).where("doc_id is not null and n_shingles > 0")
    return described.groupBy("doc_id").agg({"n_shingles": "max", "d1": "min"}).selectExpr("doc_id", "`max(n_shingles)` as n_shingles", "doc_id = 5002 as several")


@pytest.mark.parametrize("share", [8, 3, 1])
def test_only_sets_that_others_cover_stay(spark, monkeypatch, share):
    rows = mosaics(np.random.default_rng(1))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(N, "ROUND_SHARE", share)
    left = {r[0] for r in N.peeled(frame.where("doc_id is not null"), sets_of(frame), 5, 8, 10).collect()}
    copies = {x for i in range(0, 300, 10) for x in (i, 300 + i)}
    assert copies | {3, 5000, 5001, 5002} == left


def test_families_do_not_grow_with_shared_passages(spark, monkeypatch):
    """A sketch with a few cells, as a large corpus fills any: it took the chain of passages for one family."""
    rows = mosaics(np.random.default_rng(2))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(N, "LOG2_CELLS", 16)
    monkeypatch.setattr(N, "MOST_LOG2_CELLS", 16)
    monkeypatch.setattr(N, "_cell", lambda tokens, log2: np.zeros(len(tokens), np.int64))
    seen, whole = [], N.family_parts

    def watched(tokens, *rest):
        seen.append([r[0] for r in tokens.groupBy("family").count().select("count").collect()])
        return whole(tokens, *rest)

    monkeypatch.setattr(N, "family_parts", watched)
    found = {(d, c) for d, _, c in N.ngram_components(frame).collect()}
    assert max(seen[0]) <= 4
    want = {i: i for i in range(300)} | {300 + i: i for i in range(0, 300, 10)} | {5000: 5000, 5001: 5000, 5002: 3, 5003: 5003, 5004: 5004, None: None}
    assert found == set(want.items())


@pytest.mark.parametrize("seed", range(4))
def test_slices_are_whole(seed):
    rng = np.random.default_rng(seed)
    sets = [np.sort(rng.integers(0, 1 << 62, n)).astype(np.uint64) for n in (0, 5, 200, 1)]
    tokens, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    edges = [0, *sorted(rng.integers(0, 1 << N.SLICE_BITS, 3).tolist()), 1 << N.SLICE_BITS]
    parts = [N.token_slice(tokens, at, a, b) for a, b in zip(edges, edges[1:])]
    for i, s in enumerate(sets):
        assert sorted(np.concatenate([t[o[i] : o[i + 1]] for t, o in parts]).tolist()) == s.tolist()


def test_passing_tables_go(spark, tmp_path):
    from pathlib import Path

    root = Path(common.scratch_root(spark).removeprefix("file:"))
    with common.passing(spark):
        gone, stays = common.scratch(spark.range(5), "gone"), common.scratch(spark.range(6), "stays", keep=True)
        assert list(root.glob("gone-*"))
        common.discard(gone)  # may go before
        common.scratch(spark.range(7), "gone")
    assert not list(root.glob("gone-*")) and stays.count() == 6
