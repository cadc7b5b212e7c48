"""Linked sets share a segment key on which one of them counts as the smaller; others seldom do."""

import numpy as np
import pytest

from statloom.llm import segments


def joined(*sets):
    return np.concatenate(sets), np.cumsum([0, *map(len, sets)])


def meet(a, b, num, den):
    keys, small, at = segments.segment_keys(*joined(a, b), num, den)
    common, i, j = np.intersect1d(keys[: at[1]], keys[at[1] :], return_indices=True)
    return bool((small[: at[1]][i] | small[at[1] :][j]).any())


def linked_pair(rng, n, num, den):
    """A set of n tokens and another that differs in as many tokens as a link allows, taken away or added."""
    a = rng.integers(0, 1 << 62, n).astype(np.uint64)
    gone = int(rng.integers(0, n * (den - num) // den + 1))
    most = (den * (n - gone) - num * n) // num  # den * both >= num * (n + added)
    b = np.concatenate([a[gone:], rng.integers(0, 1 << 62, most).astype(np.uint64)])
    return np.sort(a), np.sort(b)


@pytest.mark.parametrize("num,den", [(9, 10), (19, 20), (99, 100), (8, 10), (1, 2), (1, 3), (1, 1)])
def test_linked_sets_meet(num, den):
    rng = np.random.default_rng(num * den)
    for n in [*range(1, 60), *rng.integers(60, 2000, 120).tolist()]:
        for _ in range(6 if n < 60 else 2):
            a, b = linked_pair(rng, n, num, den)
            both = len(np.intersect1d(a, b))
            assert den * both >= num * (len(a) + len(b) - both)
            assert meet(a, b, num, den) and meet(b, a, num, den)


def test_agreement_in_empty_segments_only():
    """Pairs whose common segments are all empty meet by segments less one token, or by empty ones."""
    rng = np.random.default_rng(3)
    num, den, seen, bare = 1, 2, 0, 0
    for _ in range(4000):
        a, b = linked_pair(rng, int(rng.integers(4, 14)), num, den)
        keys, _, at = segments.segment_keys(*joined(a, b), num, den)
        edges = segments.class_edges(max(len(a), len(b)), num, den)
        space = int(np.searchsorted(edges, min(len(a), len(b)), side="right")) - 1
        k = int((edges[space + 1] - 1) * (den - num) // num + 1)
        part = [{} for _ in range(2)]
        for held, s in zip(part, (a, b)):
            for t, g in zip(s.tolist(), ((segments.mix(s ^ segments._DEAL) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).tolist()):
                held.setdefault(g, set()).add(t)
        if not any(part[0].get(g) == part[1].get(g) for g in part[0]):
            seen += 1
            bare += all(k + 1 <= 2 * (k - len(p)) + sum(len(x) == 1 for x in p.values()) for p in part)
        assert meet(a, b, num, den)
    assert seen > 20 and bare > 0


def test_common_passages_give_no_key():
    """Documents that share a third of their tokens, however many do, have no key in common."""
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 1 << 62, 100)
    sets = [np.sort(np.concatenate([passage, rng.integers(0, 1 << 62, 200)])).astype(np.uint64) for _ in range(300)]
    keys, _, at = segments.segment_keys(*joined(*sets), 9, 10)
    owner = np.repeat(np.arange(len(sets)), np.diff(at))
    order = np.argsort(keys, kind="stable")
    again = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    touched = set(owner[order][again].tolist()) | set(owner[order][again + 1].tolist())
    assert len(touched) < len(sets) / 4
    assert np.median(np.diff(at)) < 300 / 4 and np.diff(at).max() <= 2 * 300 + 300 / 4  # the latter with an empty segment


def test_defined_cases():
    none = np.zeros(0, np.uint64)
    keys, small, at = segments.segment_keys(none, np.zeros(1, np.int64), 9, 10)
    assert len(keys) == len(small) == 0 and at.tolist() == [0]
    keys, small, at = segments.segment_keys(np.array([7], np.uint64), np.array([0, 0, 1, 1]), 9, 10)
    assert np.diff(at).tolist() == [0, 1, 0] and small.all()
    assert segments.suits(9, 10) and segments.suits(1, 1) and not segments.suits(8, 10)
