"""Removal of word passages that an earlier document has, by repeated-phrase automata."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.blocks import (
    Block,
    Mail,
    Message,
    Numbers,
    anchors,
    covered,
    each_block,
    exchange,
    keep,
    names,
    ordered_ids,
    pack,
    pack_sorted,
    per_key,
    runs_of,
    send,
    some_smaller,
    unpack,
    unpack_sorted,
    write_blocks,
)

WINDOW = 50
PHRASE = 8

KEPT_TEXTS = (
    "doc_id string, n_words bigint, removed array<struct<start: bigint, end: bigint>>,"
    " kept_text string"
)


class Words:
    """The words of a block's documents, numbered from 1, with a 0 behind each document."""

    def __init__(self, block: Block) -> None:
        vocabulary = Numbers({b"": 0})
        numbers: list[int] = []
        ends = []
        for text in block.texts():
            numbers.extend(map(vocabulary.__getitem__, text.split()))
            numbers.append(0)
            ends.append(len(numbers))
        self.ends = np.array(ends, np.int64)
        self.sizes = np.diff(self.ends, prepend=0)
        self.numbers = np.array(numbers, np.int64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
        self.hashes = hashes[self.numbers]
        self.document = np.repeat(np.arange(len(ends)), self.sizes)

    def fits(self, length: int) -> np.ndarray:
        """Whether a run of ``length`` words starts here, for every place with room behind it."""
        n = len(self.numbers) - length + 1
        if n <= 0:
            return np.zeros(0, bool)
        # The 0 behind a document is no word of it.
        return np.arange(n) + length <= self.ends[self.document[:n]] - 1


def _phrases(words: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and names of the phrases chosen to stand for the windows they are in."""
    run = names(words.hashes, phrase)
    at = anchors(run, words.fits(window), window - phrase + 1)
    return at, run[at]


def _located(words: Words, phrases: np.ndarray, phrase: int) -> np.ndarray:
    """First places of all occurrences of the phrases (given by a place each), by one automaton."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for at in phrases.tolist():
        automaton.add_word(tuple(words.numbers[at : at + phrase].tolist()), 1)
    if not len(automaton):
        return np.zeros(0, np.int64)
    automaton.make_automaton()
    found = [end for end, _ in automaton.iter(tuple(words.numbers.tolist()))]
    return np.array(found, np.int64) - phrase + 1


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    phrase: int = PHRASE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Documents without the words that are in a window which an earlier document has.

    (doc_id, n_words, removed, kept_text). Words are runs of anything but ASCII
    white space; a window is ``window`` of them in a row. A word goes if one of
    its windows, word for word, also starts in a document with a smaller id, as
    the input has it. ``removed`` are the runs of words that went, by their
    numbers from 0; ``kept_text`` the rest, joined by one space. Null and empty
    texts have no words. A null id is larger than all others; rows that share an
    id do not remove each other's words.

    1. Every window is represented by one phrase of ``phrase`` words in it, the one
       of least hash; equal windows have equal phrases. Phrases are counted over
       all documents, and only those in at least two are repeated.
    2. The repeated phrases are compiled into Aho-Corasick automata, one per block
       of documents and with those phrases the block can have, so that no automaton
       grows with the corpus. Each streams the words of its documents once and
       locates every occurrence; windows with an occurrence are candidates.
    3. Candidate windows are confirmed over all documents: the smallest id of each
       decides. Windows are told apart by 64 bits of their hash.

    No window is left out and none is counted twice for a block, so a passage in
    very many documents costs one entry per block.
    """
    if not 0 < phrase <= window:
        raise ValueError("a phrase is a part of a window")
    blocks = write_blocks(docs, id_column, text_column)
    ranges = blocks.ranges

    def tell_phrases(block: Block, mail: Mail) -> Iterator[Message]:
        words = Words(block)
        at, run = _phrases(words, window, phrase)
        yield keep("places", pack_sorted(at))
        keys, which = np.unique(run, return_inverse=True)
        low = np.full(len(keys), len(words.sizes))
        high = np.full(len(keys), -1)
        np.minimum.at(low, which, words.document[at])
        np.maximum.at(high, which, words.document[at])
        yield from send("phrase", keys, 1 + (low < high).astype(np.uint64), ranges)

    def count(kind: str, keys: np.ndarray, values: np.ndarray, begins: np.ndarray):
        repeated = np.add.reduceat(values, begins) > 1
        return per_key(repeated.astype(np.uint64), begins, len(values)), None

    def tell_windows(block: Block, mail: Mail) -> Iterator[Message]:
        words = Words(block)
        at = unpack_sorted(mail.kept("places")).astype(np.int64)
        keys, first = np.unique(names(words.hashes, phrase)[at], return_index=True)
        repeated = at[first[mail.answers("phrase") > 0]]
        found = _located(words, repeated, phrase)
        # Windows start up to window - phrase places before a located phrase.
        reach = window - phrase + 1
        total = len(words.numbers)
        near = covered(np.maximum(found - reach + 1, 0), reach, total)
        starts = np.flatnonzero(near[: max(0, total - window + 1)] & words.fits(window))
        keys, which = np.unique(names(words.hashes, window)[starts], return_inverse=True)
        owners = ordered_ids(block.ids)[words.document[starts]]
        least = np.full(len(keys), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, which, owners)
        # The pass that follows needs no more of the words than where they are.
        yield keep("starts", pack_sorted(starts))
        yield keep("which", pack(which.astype(np.uint64)))
        yield keep("later", pack((owners > least[which]).astype(np.uint64)))
        yield from send("window", keys, least, ranges)

    def earlier(kind: str, keys: np.ndarray, values: np.ndarray, begins: np.ndarray):
        return some_smaller(values, begins), None

    def cut(block: Block, mail: Mail) -> Iterator[pd.DataFrame]:
        starts = unpack_sorted(mail.kept("starts")).astype(np.int64)
        which = unpack(mail.kept("which")).astype(np.int64)
        goes = (mail.answers("window")[which] > 0) | (unpack(mail.kept("later")) > 0)
        yield pd.DataFrame(_kept(block, starts[goes], window))

    first = exchange(blocks, None, tell_phrases, count)
    second = exchange(blocks, first, tell_windows, earlier)
    kept = each_block(blocks, second, cut, KEPT_TEXTS)
    return kept.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _kept(block: Block, starts: np.ndarray, window: int) -> dict[str, list]:
    """What is left without the windows that start at these places, a 0 behind each document."""
    sizes, spans, texts = [], [], []
    begin, at = 0, 0
    for text in block.texts():
        words = text.split()
        upto = at + int(np.searchsorted(starts[at:], begin + len(words)))
        gone = covered(starts[at:upto] - begin, window, len(words))
        first, last = runs_of(gone)
        spans.append([{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        stay = compress(words, (~gone).tolist()) if upto > at else words
        texts.append(b" ".join(stay).decode())
        sizes.append(len(words))
        begin, at = begin + len(words) + 1, upto
    return {"doc_id": block.shown_ids(), "n_words": sizes, "removed": spans, "kept_text": texts}
