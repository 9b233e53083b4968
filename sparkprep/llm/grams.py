"""The word n-grams of a block of documents, numbered level by level."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from sparkprep.llm.blocks import Numbers, ordered, pack, paired, unpack_all


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and which of them each value is."""
    order, ranked = ordered(values)
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(new) - 1
    return ranked[new], order[new], which


def firsts(values: np.ndarray) -> np.ndarray:
    """A place of each distinct value, in the order of the values."""
    order, ranked = ordered(values)
    return order[np.concatenate((np.ones(min(1, len(order)), bool), ranked[1:] != ranked[:-1]))]


def numbered(
    texts: Iterable[bytes], end: bytes, begin: bytes | None = None
) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of some texts, how many each text has, and the words by number.

    An end (0) follows each text and, if ``begin`` is given, a beginning (1) comes
    before it. Words are lower-cased (A-Z).
    """
    numbers = Numbers({end: 0} if begin is None else {end: 0, begin: 1})
    tokens: list[int] = []
    ends = []
    for text in texts:
        if begin is not None:
            tokens.append(1)
        tokens.extend(map(numbers.__getitem__, text.lower().split()))
        tokens.append(0)
        ends.append(len(tokens))
    sizes = np.diff(np.array(ends, np.int64), prepend=0)
    return np.array(tokens, np.int64), sizes, list(numbers)


def pack_words(texts: list[bytes]) -> bytes:
    """What ``unpack_words`` reads, in bytes that compress well: frequent words first, like words together.

    Arrow cuts the texts, so Python does nothing per word.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = np.concatenate(([0], np.cumsum(lengths)))
    buffers = [None, pa.py_buffer(edges), pa.py_buffer(b"".join(texts))]
    # Both functions look at bytes below 0x80 only.
    whole = pa.Array.from_buffers(pa.large_string(), len(texts), buffers)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    edges, words = lists.offsets.to_numpy(), lists.values
    # White space at either end of a text leaves an empty word.
    full = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    coded = words.filter(full).dictionary_encode()
    which, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary())
    # Alike by their first bytes is enough here.
    named = pc.array_sort_indices(pc.binary_slice(words, 0, 8)).to_numpy()
    often = np.bincount(which, minlength=len(words))[named]
    order = named[np.argsort(-often, kind="stable")]
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    every = pa.ListArray.from_arrays([0, len(order)], words.take(pa.array(order)))
    shown = pc.binary_join(every, pa.scalar(b" ", pa.large_binary()))[0].as_buffer()
    body = pack(np.diff(upto[edges])) + pack(number[which])
    return len(shown).to_bytes(8, "little") + shown.to_pybytes() + body


def unpack_words(data: bytes, end: bytes, begin: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """What ``numbered`` gives, but for the order of the words."""
    at = 8 + int.from_bytes(data[:8], "little")
    sizes, inner = (values.view(np.int64) for values in unpack_all(data[at:]))
    sizes = sizes + 2
    ends = np.cumsum(sizes)
    tokens = np.full(int(sizes.sum()), -1, np.int64)
    tokens[ends - sizes], tokens[ends - 1] = 1, 0
    tokens[tokens < 0] = inner + 2
    return tokens, sizes, [end, begin, *data[8:at].split()]


class Places:
    """The words of some documents, and the n-grams that end at each place.

    ``sizes`` and ``starts`` are those of the documents, ``since`` counts the words
    of the document ahead of each place. Words are told apart by 64 bits of their hash.
    """

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, words: list[bytes]) -> None:
        self.tokens, self.sizes = tokens, sizes
        self.starts = np.cumsum(sizes) - sizes
        self.since = np.arange(len(tokens)) - np.repeat(self.starts, sizes)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self._runs = [self.hashes[tokens]]

    def run(self, level: int) -> np.ndarray:
        """The key of what ends at each place, if the document is long enough."""
        while len(self._runs) <= level:
            run = self._runs[-1]
            self._runs.append(np.concatenate((run[:1], paired(run[:-1], self._runs[0][1:]))))
        return self._runs[level]

    def level(
        self, level: int, low: int = 0, high: int = 1 << 64
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct keys of a level from ``low`` to below ``high``, a place of each, and for each place which one ends there (or -1)."""
        if level == 0 and high - low == 1 << 64:
            # Words are numbered already; only longer runs have to be sorted.
            keys, _, which = distinct(self.hashes)
            which = which[self.tokens]
            first = np.zeros(len(keys), np.int64)
            first[which] = np.arange(len(which))
            return keys, first, which
        there = self.there(level, low, high)
        keys, first, which = distinct(self.run(level)[there])
        full = np.full(len(self.tokens), -1, np.int64)
        full[there] = which
        return keys, there[first], full

    def there(self, level: int, low: int = 0, high: int = 1 << 64) -> np.ndarray:
        """Places in which an n-gram of a level ends, its key from ``low`` to below ``high``."""
        found = self.since >= level
        if high - low < 1 << 64:
            run = self.run(level)
            found &= (run >= np.uint64(low)) & (run <= np.uint64(high - 1))
        return np.flatnonzero(found)

    def firsts(self, level: int) -> np.ndarray:
        """A place of each distinct n-gram of a level, in the order of their keys."""
        there = self.there(level)
        return there[firsts(self.run(level)[there])]


class Grams(Places):
    """The n-grams of some documents, level by level.

    ``tokens`` are word numbers with an end (0) after each document and, if
    ``begin`` is given, a beginning (1) before it. Level k lists the distinct
    k-grams: their keys, a place in which each ends, and for each place which one
    ends there (-1 where the document is too short). Words are lower-cased (A-Z).
    """

    def __init__(
        self, texts: Iterable[bytes], order: int, end: bytes, begin: bytes | None = None
    ) -> None:
        super().__init__(*numbered(texts, end, begin))
        levels = [self.level(k) for k in range(order)]
        self.keys, self.first, self.which = map(list, zip(*levels, strict=True))

    def counts(self, level: int, places: np.ndarray) -> np.ndarray:
        """How often each k-gram ends at the places that are marked."""
        at = places & (self.which[level] >= 0)
        return np.bincount(self.which[level][at], minlength=len(self.keys[level]))
