"""The count sketch of the n-gram join grows with the text."""

import numpy as np

from statloom.llm import ngram_join as N


def test_more_text_has_more_cells():
    assert N.log2_cells(0) == N.LOG2_CELLS == 22 and N.log2_cells(10**12) == N.MOST_LOG2_CELLS
    for size in (2 * 10**8, 4 * 10**8, 9 * 10**8):
        assert size / N.CELL_BYTES <= 1 << N.log2_cells(size)


def test_the_size_changes_no_result(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 60)]
        rows.append((2 * i, " ".join(words)))
        if i % 2:
            words[-1] = "other"
        rows.append((2 * i + 1, " ".join(words if i % 4 < 2 else words[:30])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(N, "LOG2_CELLS", 16)
    found, sizes = [], []
    for cell_bytes in (28, 0.05):
        monkeypatch.setattr(N, "CELL_BYTES", cell_bytes)
        sizes.append(N.log2_cells(sum(len(t) for _, t in rows)))
        found.append(sorted(map(tuple, N.ngram_components(docs).collect())))
    assert sizes[0] == 16 < sizes[1] and found[0] == found[1]
    assert {d: c for d, _, c in found[0]} == {2 * i + j: 2 * i if i % 4 < 2 else 2 * i + j for i in range(40) for j in (0, 1)}
