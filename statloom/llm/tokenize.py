"""Token ids of whole texts by a public tokenizer, at the cost of its distinct words.

The tokenizer drops white space and never joins words, so a text's ids are those of its
blank-separated words in turn.  A chunk's words are dictionary-encoded, each distinct word
is tokenized once, and the ids are gathered by index.
"""

from __future__ import annotations

import os

import numpy as np

_LOADED: dict = {}
#: Bytes of text whose words are looked up together.
GATHERED_BYTES = 3 << 20
#: Words in one call of the tokenizer.
CALL_WORDS = 4096
#: Words whose ids are gathered at once.
SLICE_WORDS = 1 << 16


def load(path: str):
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _of_words(tok, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of words; they are joined to long strings, and each id belongs to the word in which it starts."""
    flat, size = [], []
    for i in range(0, len(words), CALL_WORDS):
        some = words[i : i + CALL_WORDS]
        length = np.fromiter(map(len, some), np.int64, len(some)) + 1
        e = tok.encode(" ".join(some), add_special_tokens=False)
        begin = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
        flat.append(np.array(e.ids, np.uint32))
        size.append(np.bincount(np.searchsorted(np.cumsum(length), begin, side="right"), minlength=len(some)))
    ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
    return ids, np.concatenate([[0], np.cumsum(np.concatenate(size))]) if size else np.zeros(1, np.int64)


#: Distinct words that a worker remembers between chunks; beyond that it starts anew.
REMEMBERED = 1 << 20
#: Remembered words among which others are looked up at once.
LOOKUP_WORDS = 1 << 17


class _Memory:
    """Ids of the words seen so far by this process."""

    def __init__(self):
        import pyarrow as pa

        self.words = pa.array([], pa.string())
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def places(self, tok, words) -> np.ndarray:
        """The place of each distinct word; new ones are tokenized and kept."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.words) > REMEMBERED:
            self.__init__()
        # by blocks of words, as Arrow builds a hash table of what it is asked to look in
        place, rest, at = np.full(len(words), -1, np.int64), words, np.arange(len(words))
        for first in range(0, len(self.words), LOOKUP_WORDS):
            found = pc.index_in(rest, value_set=self.words.slice(first, LOOKUP_WORDS))
            known = pc.is_valid(found).to_numpy(zero_copy_only=False)
            place[at[known]] = first + found.drop_null().to_numpy()
            rest, at = rest.filter(pc.is_null(found)), at[~known]
        if len(rest):
            ids, ends = _of_words(tok, rest.to_pylist())
            place[at] = len(self.words) + np.arange(len(rest))
            self.words = pa.concat_arrays([self.words, rest])
            self.at = np.concatenate([self.at, self.at[-1] + ends[1:]])
            self.ids = np.concatenate([self.ids, ids])
        return place


_MEMORY: dict[str, _Memory] = {}


def _coded(path: str, texts: list[bytes]):
    """(memory, place of each word, first word of each text and the end)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    tok, memory = load(path), _MEMORY.setdefault(path, _Memory())
    split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
    first = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    place = memory.places(tok, coded.dictionary)
    return memory, place.astype(np.int32)[coded.indices.to_numpy()], first - first[0]


def token_ids(path: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the ids of text i are ids[offsets[i]:offsets[i+1]]."""
    memory, word, first = _coded(path, texts)
    size, begin = np.diff(memory.at).astype(np.int32), memory.at[:-1].astype(np.int32)
    stop = np.zeros(len(word) + 1, np.int64)
    np.cumsum(size[word], out=stop[1:])
    ids = np.empty(stop[-1], np.uint32)
    # by slices of words: what is held for each token but its id is bounded
    for a in range(0, len(word), SLICE_WORDS):
        some, at = word[a : a + SLICE_WORDS], stop[a : a + SLICE_WORDS + 1]
        many = size[some]
        where = np.repeat(begin[some] - (at[:-1] - at[0]).astype(np.int32), many)
        where += np.arange(len(where), dtype=np.int32)
        ids[at[0] : at[-1]] = memory.ids[where]
    return ids, stop[first]


def token_counts(path: str, texts: list[bytes]) -> np.ndarray:
    memory, word, first = _coded(path, texts)
    stop = np.concatenate([[0], np.cumsum(np.diff(memory.at)[word])])
    return np.diff(stop[first])


def gathered(batches, text: str, columns: list[str], limit: int = GATHERED_BYTES):
    """(a table of the columns, texts as bytes) of several Arrow batches at once, about limit bytes of text."""
    import pyarrow as pa

    from .common import chunks, trim

    held, texts, size = [], [], 0
    for part, some in chunks(batches, text, limit):
        held.append(part.select(columns))
        texts += some
        size += sum(map(len, some))
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks(), texts
            held, texts, size = [], [], 0
            trim()
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), texts
