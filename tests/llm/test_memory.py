"""What a Python worker holds beside its chunk of text."""

import pickle
import random
import tracemalloc

import numpy as np

from statloom.llm import common, ordinal, tokenize


def words(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_arrays_of_token_ids_are_bounded():
    path, texts = tokenize.default_path(), [" ".join(words(2000) * 200).encode()]
    want = tokenize.token_ids(path, texts)[0]
    tracemalloc.start()
    ids, at = tokenize.token_ids(path, texts)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (ids == want).all() and at.tolist() == [0, len(ids)]
    assert held < 26 * len(ids)


def test_words_are_looked_up_by_blocks(monkeypatch):
    path, texts = tokenize.default_path(), [" ".join(words(300, seed)).encode() for seed in (1, 2, 1, 4)]
    tok = tokenize.load(path)
    want = [tok.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(tokenize, "LOOKUP_WORDS", 7, raising=False)
    monkeypatch.setattr(tokenize, "SLICE_WORDS", 11, raising=False)
    monkeypatch.setattr(tokenize, "_MEMORY", {})
    for _ in range(2):
        got = []
        for some in (texts[:2], texts[1:], []):
            ids, at = tokenize.token_ids(path, some)
            got += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
        assert got == want[:2] + want[1:]


def test_kept_powers_are_little_more_than_a_chunk_needs():
    up, down = common.powers(np.uint64(3), (1 << 19) + 1)
    assert (1 << 19) < len(up) == len(down) <= (1 << 19) + (1 << 16)
    assert (up[:1000] * down[:1000] == 1).all()
    common._POWERS.pop(3)


def test_fit_of_grades_is_small_on_the_driver():
    """8000 documents of 450 features: the fit peaked at 119 MB beyond its input, and 16.8 MB of weights were sent."""
    rng, n, features = np.random.default_rng(1), 8000, 450
    doc, slot = np.repeat(np.arange(n, dtype=np.int32), features), (rng.zipf(1.3, n * features) % (1 << 22)).astype(np.int32)
    grade = rng.integers(0, 3, n)
    tell = np.flatnonzero(rng.random(n) < 0.5) * features
    slot[tell] = 4_000_000 + grade[doc[tell]]
    tracemalloc.start()
    model = ordinal.fit_ordinal(doc, slot, grade, 3, rounds=20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6, peak
    sent = pickle.dumps(model)
    assert len(sent) < 1 << 20
    back = pickle.loads(sent)
    assert (back.weights == model.weights).all() and (back.thresholds == model.thresholds).all() and (model.weights != 0).any()
