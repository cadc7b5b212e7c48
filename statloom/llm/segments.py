"""Candidate keys of a similarity self-join by segments of token sets.

Tokens are dealt to k segments by hash.  Two sets that differ in at most k - 1 tokens agree in
a whole segment, so one key for each segment, the hash of the tokens in it, meets every linked
pair.  A segment holds several tokens: a passage that many documents share gives no
common key unless it makes up nearly all of them, whatever its frequency, so no count of
the corpus's tokens is needed.

Sizes are cut into classes, each ending where the largest set that its least one can link with
ends.  Linked sets lie in one class or in neighbouring ones; a set has keys in its own class's
space, and, as the larger set of a pair, in the space of the class below.

Segments without tokens have no key of their own, as all sets that lack tokens there would meet.
Should all segments in which a linked pair agrees be empty, then most others differ in one token
alone: sets with an empty segment also have the keys of their segments less any one token.  Only a set with
too few filled segments for that argument (``sparse`` below) has keys for empty ones.
"""

from __future__ import annotations

import numpy as np

from .common import mix

#: Least mean number of tokens of a segment for which segments tell sets apart well.
SEGMENT_TOKENS = 6
_DEAL, _SUM, _NAME = (np.uint64(x) for x in (0x6A09E667F3BCC909, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B))
_HALF = np.uint64(32)


def suits(num: int, den: int) -> bool:
    """Whether segments hold SEGMENT_TOKENS tokens on average at a similarity of num / den: they hold num**2 / (den * (den - num)) at least."""
    return num * num >= SEGMENT_TOKENS * den * (den - num)


def class_edges(largest: int, num: int, den: int) -> np.ndarray:
    """The least sizes of the classes, up to that of the second class after largest."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * den // num + 1)
    return np.array([*edges, edges[-1] * den // num + 1], np.int64)


def segment_keys(tokens: np.ndarray, at: np.ndarray, num: int, den: int):
    """(keys, whether the set may be a pair's smaller one there, offsets) of the sets tokens[at[i]:at[i + 1]]."""
    size = np.diff(at)
    edges = class_edges(int(size.max(initial=0)), num, den)
    own = np.searchsorted(edges, size, side="right") - 1
    owner = np.repeat(np.arange(len(size)), size)
    dealt, value = mix(tokens ^ _DEAL) >> _HALF, mix(tokens ^ _SUM)
    keys, smaller, holder = [], [], []

    def add(found, docs, small):
        keys.append(found)
        holder.append(docs)
        smaller.append(np.full(len(found), small))

    for space, small in ((own, True), (own - 1, False)):
        used = (size > 0) & (space >= 0)
        k = np.where(used, (edges[np.maximum(space, 0) + 1] - 1) * (den - num) // num + 1, 0)
        start = np.concatenate([[0], np.cumsum(k)])
        mine = used[owner]
        slot = start[owner[mine]] + (dealt[mine] * k[owner[mine]].astype(np.uint64) >> _HALF).astype(np.int64)
        doc = np.repeat(np.arange(len(size)), k)
        name = mix((space[doc].astype(np.uint64) << _HALF | (np.arange(start[-1]) - start[doc]).astype(np.uint64)) ^ _NAME)
        total, count = np.zeros(start[-1], np.uint64), np.bincount(slot, minlength=start[-1])
        np.add.at(total, slot, value[mine])
        held = count > 0
        add(mix(total ^ name)[held], doc[held], small)
        empty = np.bincount(doc[~held], minlength=len(size))
        if empty.any():
            less = (empty[owner[mine]] > 0) & (count[slot] > 1)
            add(mix((total[slot] - value[mine]) ^ name[slot])[less], owner[mine][less], small)
            single = np.bincount(doc[count == 1], minlength=len(size))
            sparse = (empty > 0) & (k + 1 <= 2 * empty + single)
            bare = ~held & sparse[doc]
            add(mix(name)[bare], doc[bare], small)
    keys, smaller, holder = (np.concatenate(x) for x in (keys, smaller, holder))
    order = np.argsort(holder, kind="stable")
    return keys[order], smaller[order], np.searchsorted(holder[order], np.arange(len(size) + 1))
